"""The registered queries of this subpackage: name to (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import fingerprint, table
from . import credentials, distinctive, leakage, mixing, neighbours, packing, ranks, residue


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.most_distinctive(distinctive.score_terms(table(spark, folder, "postings"), table(spark, folder, "nodes")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return packing.cut_texts(table(spark, folder, "processed_deps"), table(spark, folder, "pack_windows"))


def p2_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, folder, "processed_deps"), table(spark, folder, "pack_windows")))


def p2_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each window, and that no prompt is overfull and little room is left over."""
    return packing.window_report(packing.pack(table(spark, folder, "processed_deps"), table(spark, folder, "pack_windows")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, folder, "vector_store"))


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose hash is divisible by 50, against all chunks."""
    chunks = neighbours.current_chunks(table(spark, folder, "vector_store"))
    asked = chunks.filter(fingerprint("id") % 50 == 0).select("id")
    found = neighbours.nearest(chunks, queries=asked)
    return found.select(F.col("id").alias("chunk_id"), "neighbour", F.round("similarity", 4).alias("similarity"), "rank")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return ranks.best_nodes(table(spark, folder, "search_hits"))


def p4_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Points and position of every node of the ranked lists."""
    return ranks.borda(ranks.stream_scores(table(spark, folder, "streams")), missing="middle")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.credential_lines(table(spark, folder, "nodes"))


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Of every node's source after redaction: whether all offsets are as before, and nothing is left to find."""
    return credentials.redaction_report(table(spark, folder, "nodes"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "eval_items"), table(spark, folder, "documents"))


def p7_altered(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps in which words of the item were substituted."""
    return leakage.altered(table(spark, folder, "eval_items"), table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.short_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The share of expected tokens that each source has in the mix."""
    report = mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]
    return report.select("source", F.round("rate_share", 3).alias("share"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_documents(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_fill, p2_windows, p3_found, p3_search, p4_found, p4_streams, p6_found, p6_redacted, p7_found, p7_altered, p8_found, p8_mix, p8_report, p9_found)}
