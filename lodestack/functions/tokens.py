"""Token estimates and the query tokenizer, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that mostly stand as tokens of their own.
STANDALONE = "{}()[]:;,=<>&|#@"


def token_estimate(text: Column) -> Column:
    """max(ceil(bytes / 3.2), standalone signs / 3, 1); 0 for an empty text, null for null."""
    signs = F.length(text) - F.length(F.translate(text, STANDALONE, ""))
    by_bytes = F.ceil(F.octet_length(text) * 5 / F.lit(16))
    return F.when(F.octet_length(text) == 0, F.lit(0).cast("long")).when(text.isNotNull(), F.greatest(by_bytes, F.floor(signs / 3), F.lit(1).cast("long")))


def query_terms(text: Column) -> Column:
    """Lower-case words of a query, split at signs and where a small letter meets a capital one."""
    split = F.regexp_replace(text, r"(?<=\p{IsLowercase})(?=\p{IsUppercase})", " ")
    parts = F.split(F.lower(split), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda p: p != "")
