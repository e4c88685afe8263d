"""A Spark-native engine for code and text retrieval over DataFrames."""

__version__ = "0.1.0"
