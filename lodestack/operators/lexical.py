"""Weighted lexical search over postings, and trigram search over texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..runtime import clash_free

DEFAULT_SCALE = 6.0


def terms_of(query: str) -> list[str]:
    """Distinct lower-case words of a query in order, split at signs and from small to capital letters."""
    found: list[str] = []
    for part in re.findall(r"[^\W_]+", query):
        pieces = re.sub(r"([a-zß-öø-ÿ])([A-ZÀ-ÖØ-Þ])", r"\1 \2", part).split()
        found += [p.lower() for p in pieces]
    return list(dict.fromkeys(found))


def lexical_search(postings: DataFrame, query: str, k: int = 10, scale: float = DEFAULT_SCALE) -> DataFrame:
    """node_id, score: summed weights of the query's terms, less the further apart their lines lie.

    Only sums and extremes leave the scan of each partition. Postings without term, node or line, or with a
    weight that is null, NaN or not positive, don't count; ties go to the smaller node_id. A blank query or
    k below 1 gives no rows; a scale that is not positive and finite becomes 6.
    """
    scale = scale if scale > 0 and scale < float("inf") else DEFAULT_SCALE
    terms = terms_of(query)
    rows = clash_free(postings, "term", "node_id", "line", "weight").filter(F.col("term").isin(terms) if terms else F.lit(False))
    rows = rows.filter("node_id is not null and line is not null and weight > 0 and not isnan(weight)")
    hits = rows.groupBy("node_id").agg(F.sum("weight").alias("total"), (F.max("line") - F.min("line")).alias("span"), F.count("*").alias("hits"))
    score = F.when(F.col("hits") > 1, F.col("total") * F.exp(-F.col("span") / scale)).otherwise(F.col("total"))
    return hits.select("node_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "node_id").limit(max(k, 0))


def trigrams(text: Column) -> Column:
    """Lower-case runs of three code points in order; a shorter text is its own only one, an empty one has none."""
    def runs(low: Column) -> Column:
        length = F.length(low)
        parts = F.transform(F.sequence(F.lit(1), F.greatest(length - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
        return F.when(length == 0, F.array().cast("array<string>")).when(length < 3, F.array(low)).otherwise(parts)

    return bind(F.lower(text), runs)


def trigram_index(chunks: DataFrame, id_column: str = "chunk_id", text_column: str = "text") -> DataFrame:
    """gram, id, n: how often each trigram occurs in each chunk, counted per text where it is read."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                ids, grams, counts = [], [], []
                for id_, low in zip(batch["id"][at : at + 500], batch["low"][at : at + 500]):
                    found = Counter(low[i : i + 3] for i in range(max(len(low) - 2, 1))) if low else {}
                    ids += [id_] * len(found)
                    grams += found.keys()
                    counts += found.values()
                yield pd.DataFrame({"gram": pd.Series(grams, dtype="object"), "id": pd.Series(ids, dtype=batch["id"].dtype), "n": pd.Series(counts, dtype="int64")})

    rows = chunks.select(F.col(id_column).alias("id"), F.lower(F.col(text_column)).alias("low")).dropna()
    counted = rows.mapInPandas(count, f"gram string, id {dict(rows.dtypes)['id']}, n long")
    return counted.groupBy("gram", "id").agg(F.sum("n").alias("n"))


def trigram_search(chunks: DataFrame, query: str, k: int = 10, id_column: str = "chunk_id", text_column: str = "text") -> DataFrame:
    """id, jaccard, score of the k chunks nearest to the query.

    jaccard compares the sets of trigrams, score counts pairs of equal trigrams; ties go to the smaller id.
    Everything about one chunk is computed where its text is read; only the best k of each partition move.
    """
    def grams_of(text: str) -> list[str]:
        low = text.lower()
        return [low[i : i + 3] for i in range(len(low) - 2)] if len(low) > 2 else [low] * bool(low)

    wanted = dict(Counter(grams_of(query)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, text in zip(batch["id"], batch["text"]):
                low = text.lower()
                if not any(gram in low for gram in wanted):
                    continue
                grams = grams_of(text)
                own = set(grams)
                shared = own & wanted.keys()
                if shared:
                    # only grams of the query are counted, and only those that occur
                    score = sum(wanted[g] for g in grams if g in shared)
                    out.append((id_, len(shared) / (len(own) + len(wanted) - len(shared)), score))
            yield pd.DataFrame(out, columns=["id", "jaccard", "score"])

    rows = chunks.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).dropna()
    found = rows.mapInPandas(compare, f"id {dict(rows.dtypes)['id']}, jaccard double, score long")
    return found.orderBy(F.desc("jaccard"), F.desc("score"), "id").limit(max(k, 0))


def gram_sizes(index: DataFrame) -> DataFrame:
    """id, grams: how many distinct trigrams each chunk of an index has; kept beside it for :func:`index_search`."""
    return index.groupBy("id").agg(F.count("*").alias("grams"))


def index_search(index: DataFrame, sizes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """What :func:`trigram_search` gives, read from a trigram index and its sizes.

    Only postings of the query's trigrams are read; they are added up for each chunk before anything moves.
    """
    low = query.lower()
    wanted = dict(Counter([low[i : i + 3] for i in range(len(low) - 2)] if len(low) > 2 else [low] * bool(low)))
    if not wanted or k < 1:
        return index.limit(0).select("id", F.lit(0.0).alias("jaccard"), F.col("n").alias("score"))
    times = F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("gram"))
    hits = index.filter(F.col("gram").isin(*wanted)).groupBy("id").agg(F.count("*").alias("shared"), F.sum(F.col("n") * times).alias("score"))
    jaccard = F.col("shared") / (F.col("grams") + len(wanted) - F.col("shared"))
    return hits.join(sizes, "id").select("id", jaccard.alias("jaccard"), "score").orderBy(F.desc("jaccard"), F.desc("score"), "id").limit(k)


def replace_chunks(index: DataFrame, chunks: DataFrame, **names: str) -> DataFrame:
    """The index with the postings of ``chunks`` put in place of any older ones of the same ids."""
    new = trigram_index(chunks, **names)
    return index.join(new.select("id").distinct(), "id", "left_anti").select("gram", "id", "n").unionByName(new)


def remove_chunks(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id", "left_anti").select("gram", "id", "n")
