"""Ranked lists and their fusion: reciprocal ranks, with confidence, and hybrid search over four streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_to, searchable_text
from ..runtime import cut, settle
from .community import communities, proximity
from .graph import dense_ids, searchable
from .lexical import lexical_search
from .pagerank import pagerank, transitions

FLOOR = 0.03


@dataclass
class FusionSettings:
    """k of at least 1, alpha in [0, 1]; weights of another number than the streams count as all one."""

    k: float = 60.0
    alpha: float = 0.0
    weights: list[float] = field(default_factory=lambda: [1.0, 1.0, 1.0, 1.0])

    def safe_k(self) -> float:
        return max(self.k, 1.0) if math.isfinite(self.k) else 60.0

    def safe_alpha(self) -> float:
        return min(max(self.alpha, 0.0), 1.0) if math.isfinite(self.alpha) else 0.0

    def safe_weights(self, streams: int) -> list[float]:
        if len(self.weights) != streams:
            return [1.0] * streams
        return [max(w, 0.0) if math.isfinite(w) else 0.0 for w in self.weights]


def as_stream(results: DataFrame, number: int, id_column: str = "node_id", most: int | None = None) -> DataFrame:
    """stream, pos (from 0, by score downwards, then id), id, score of one result list.

    With ``most`` only the first so many are kept and numbered in one task; without it ranges of scores are
    numbered side by side, however long the list is. NaN counts as the highest score, null as the lowest.
    """
    rows = results.select(F.col(id_column).alias("id"), F.col("score").cast("double").alias("score")).filter("id is not null")
    if most is not None:
        order = Window.orderBy(F.desc("score"), "id")
        rows = rows.orderBy(F.desc("score"), "id").limit(max(most, 0))
        return rows.select(F.lit(number).alias("stream"), (F.row_number().over(order) - 1).alias("pos"), "id", "score")
    ordered = rows.select("id", "score", F.col("score").isNull().alias("__none"), (~F.isnan("score")).alias("__plain"), (-F.col("score")).alias("__down"))
    numbered = dense_ids(ordered, ["__none", "__plain", "__down", "id"])
    return numbered.select(F.lit(number).alias("stream"), F.col("dense_id").cast("int").alias("pos"), "id", "score")


def fuse_three(lexical: DataFrame, semantic: DataFrame, structural: DataFrame, settings: FusionSettings | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fusion of three ranked lists with (keys,) pos, id, score; see :func:`fuse`."""
    streams = None
    for number, rows in enumerate((lexical, semantic, structural)):
        part = rows.select(*keys, F.lit(number).alias("stream"), "pos", "id", "score")
        streams = part if streams is None else streams.unionByName(part)
    return fuse(streams, 3, settings, keys=keys)


def fuse(streams: DataFrame, count: int = 4, settings: FusionSettings | None = None, structural: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """id, fused, contributions, raw, ordinal of the documents of each group of ``keys`` (all in one without).

    A document adds weight / (k + pos * (1 - alpha * its score scaled to the list's range)) for each list it
    is in. Of an id listed twice the first place counts, and the second still takes up its place. Exact
    repeats of a row count once. ``structural`` (id, score) decides ties, then the first appearance.
    """
    settings = settings or FusionSettings()
    weights = F.array(*(F.lit(float(w)) for w in settings.safe_weights(count)))
    rows = streams.select(*keys, "stream", "pos", "id", F.col("score").cast("double").alias("score")).filter("stream is not null and pos is not null and id is not null").distinct()
    finite = F.when((F.abs("score") < float("inf")) & ~F.isnan("score"), F.col("score"))
    ranges = rows.groupBy(*keys, "stream").agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
    first = rows.groupBy(*keys, "stream", "id").agg(F.min(F.struct("pos", "score")).alias("row")).select(*keys, "stream", "id", "row.*")
    joined = first.join(ranges, [*keys, "stream"])
    scaled = F.when((F.col("high") > F.col("low")) & finite.isNotNull(), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    place = F.col("pos") * (1.0 - F.least(settings.safe_alpha() * scaled, F.lit(1.0)))
    parts = joined.withColumn("part", F.get(weights, F.col("stream")) / (settings.safe_k() + place))
    def by_stream(column: str) -> list[Column]:
        return [F.max(F.when(F.col("stream") == s, F.col(column))).alias(f"{column}{s}") for s in range(count)]
    fused = parts.groupBy(*keys, "id").agg(F.min(F.struct("stream", "pos")).alias("ordinal"), *by_stream("part"), *by_stream("score"))
    # summed in order of streams, so that the same lists always give the same digits
    total = F.lit(0.0)
    for s in range(count):
        total = total + F.coalesce(f"part{s}", F.lit(0.0))
    out = fused.select(*keys, "id", total.alias("fused"), F.array(*(F.col(f"part{s}") for s in range(count))).alias("contributions"), F.array(*(F.col(f"score{s}") for s in range(count))).alias("raw"), "ordinal")
    if structural is None:
        return out.withColumn("structural", F.lit(0.0))
    return out.join(structural.select("id", F.col("score").alias("structural")), "id", "left").withColumn("structural", F.coalesce("structural", F.lit(0.0)))


FUSED_ORDER = (F.desc, "fused"), (F.desc, "structural"), (F.asc, "ordinal"), (F.asc, "id")


def best_fused(fused: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first k of each group with their position from 1."""
    order = [f(c) for f, c in FUSED_ORDER]
    if not keys:
        top = fused.orderBy(*order).limit(max(k, 0))
        return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return fused.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= k)


def query_vector(spark: SparkSession, query: str, embed) -> list[float]:
    """A query under an embedding expression, computed once."""
    return list(spark.range(1).select(embed(F.lit(query))).first()[0])


def semantic_search(vectors: DataFrame, query: list[float], k: int, floor: float = FLOOR, id_column: str = "node_id", vector_column: str = "embedding") -> DataFrame:
    """node_id, score of the k vectors of largest cosine with one query vector, none below the floor."""
    rows = vectors.select(F.col(id_column).alias("node_id"), cosine_to(query)(F.col(vector_column)).alias("score"))
    return rows.filter((F.col("score") >= floor) & F.col("node_id").isNotNull()).orderBy(F.desc("score"), "node_id").limit(max(k, 0))


BLOCK_CELLS = 64_000_000  #: products of queries and vectors that one task holds at a time


def semantic_block(vectors: DataFrame, queries: DataFrame, k: int, floor: float = FLOOR, id_column: str = "node_id", vector_column: str = "embedding", block: int = 2_048) -> DataFrame:
    """query, node_id, score, rank: for each of many queries (id, vector) the k vectors of largest cosine.

    Queries are read in blocks of at most ``block`` rows, each of which is compared with all vectors where
    these are read; only the best k of each partition move. Vectors of another length than a query are
    compared over the common length. Null ids and vectors are left out, ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("node_id"), F.col(vector_column).cast("array<double>").alias("v")).dropna()
    asked = queries.select(F.col(queries.columns[0]).alias("query"), F.col(queries.columns[1]).cast("array<double>").alias("v")).dropna()
    kinds = dict(rows.dtypes)["node_id"], dict(asked.dtypes)["query"]
    count = asked.count()
    if count <= block:
        out = _block_search(spark, rows, asked.toPandas(), k, floor, kinds)
    else:
        out = None
        numbered = cut(dense_ids(asked.repartition("query"), ["query"]).withColumn("block", F.floor(F.col("dense_id") / block)))
        for number in range(-(-count // block)):
            part = _block_search(spark, rows, numbered.filter(F.col("block") == number).select("query", "v").toPandas(), k, floor, kinds)
            out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_search(spark: SparkSession, rows: DataFrame, own: pd.DataFrame, k: int, floor: float, kinds: tuple[str, str]) -> DataFrame:
    lengths = np.array([len(v) for v in own["v"]], int)
    groups = [(int(n), np.flatnonzero(lengths == n), np.stack(own["v"][lengths == n].to_list())) for n in np.unique(lengths)]
    shared = spark.sparkContext.broadcast((own["query"].to_numpy(), groups))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, parts = shared.value
        for batch in batches:
            sizes = batch["v"].str.len().to_numpy()
            ids = batch["node_id"].to_numpy()
            for size in np.unique(sizes):
                here = np.flatnonzero(sizes == size)
                for length, at, wanted in parts:
                    width = min(length, int(size))
                    step = max(1, BLOCK_CELLS // max(len(at), 1))
                    for lo in range(0, len(here), step):
                        some = here[lo : lo + step]
                        x, y = np.stack(batch["v"].iloc[some].to_list())[:, :width], wanted[:, :width]
                        scale = np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
                        score = np.where(scale > 0, y @ x.T / np.where(scale > 0, scale, 1.0), 0.0)
                        # of rows with equal scores at the end of the list all stay; the merge decides by id
                        last = np.partition(score, -k, axis=1)[:, -k][:, None] if score.shape[1] > k else -np.inf
                        q, c = np.nonzero((score >= last) & (score >= floor))
                        yield pd.DataFrame({"query": names[at[q]], "node_id": ids[some[c]], "score": score[q, c]})

    return rows.mapInPandas(best, f"query {kinds[1]}, node_id {kinds[0]}, score double")


@dataclass
class SearchIndex:
    """What every search of a graph needs and no query changes: vectors, communities, moves of walkers."""

    vectors: DataFrame
    membership: DataFrame
    moves: DataFrame
    nodes: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, embed) -> SearchIndex:
        """Written once as tables; ``embed`` turns a text column into vectors, of a model or of hashed terms."""
        vectors = settle(node_texts(nodes).select("node_id", embed("text").alias("embedding")))
        found = settle(searchable(nodes).select("node_id", "name", "kind").dropna(subset=["node_id"]).dropDuplicates(["node_id"]))
        return cls(vectors, settle(communities(nodes, edges)), settle(transitions(edges, nodes)), found)


def seeds_of(lists: list[list[tuple[int, float]]], context: int | None, top: int = 8, context_weight: float = 4.0) -> list[tuple[int, float]]:
    """:func:`walk_seeds` of ranked lists that are at the driver already."""
    out: dict[int, float] = {} if context is None else {context: context_weight}
    for hits in lists:
        for pos, (node, _) in enumerate(hits[:top]):
            out[node] = out.get(node, 0.0) + 1.0 / (pos + 1)
    return sorted(out.items())


def walk_seeds(lexical: DataFrame, semantic: DataFrame, context: int | None, top: int = 8, context_weight: float = 4.0) -> DataFrame:
    """node_id, seed: 1/(rank+1) for the first of both lists and a fixed weight for the node under the cursor."""
    parts = [as_stream(s, n, most=top).select(F.col("id").alias("node_id"), (1.0 / (F.col("pos") + 1)).alias("seed")) for n, s in enumerate((lexical, semantic))]
    both = parts[0].unionByName(parts[1])
    if context is not None:
        both = both.unionByName(both.sparkSession.createDataFrame([(context, context_weight)], "node_id long, seed double"))
    return both.groupBy("node_id").agg(F.sum("seed").alias("seed"))


def hybrid_search(
    nodes: DataFrame,
    edges: DataFrame,
    postings: DataFrame,
    vectors: DataFrame,
    membership: DataFrame,
    query: str,
    embed,
    k: int = 10,
    context: int | None = None,
    pool: int | None = None,
    settings: FusionSettings | None = None,
    structural: DataFrame | None = None,
    rounds: int = 100,
    moves: DataFrame | None = None,
    walked: DataFrame | None = None,
) -> DataFrame:
    """position, node_id, name, kind, fused, contributions, raw of the k nodes that fit a query best.

    Lexical and semantic lists come first; their best nodes and the context node start the random walk of
    the third; the fourth ranks communities near that of the context node, or else of the best lexical or
    semantic hit. ``embed`` turns the query into a vector column. ``vectors``, ``membership`` and ``moves`` come
    from a :class:`SearchIndex`, so that a query reads them; ``walked`` are the nodes of the
    whole graph where ``nodes`` are only those that may be found. A blank query or k below 1 gives no rows.
    """
    spark = nodes.sparkSession
    found = searchable(nodes).select("node_id", "name", "kind").dropna(subset=["node_id"]).dropDuplicates(["node_id"])
    if k < 1 or not query.strip():
        return found.limit(0).select(F.lit(0).alias("position"), "node_id", "name", "kind", F.lit(0.0).alias("fused"))
    pool = pool or k * 4
    ids = found.select("node_id")
    def by_terms() -> list:
        return order(lexical_search(postings.join(ids, "node_id", "left_semi"), query, pool).collect())

    def by_vectors() -> list:
        return order(semantic_search(vectors.join(ids, "node_id", "left_semi"), query_vector(spark, query, embed), pool).collect())

    # at most ``pool`` rows of each list come to the driver, and all that follows is planned over them
    order = lambda rows: sorted(((r["node_id"], float(r["score"])) for r in rows), key=lambda r: (-r[1], r[0]))
    with ThreadPoolExecutor(2) as pool_of_two:  # neither list needs the other
        lists = [f.result() for f in [pool_of_two.submit(f) for f in (by_terms, by_vectors)]]
    seeds = spark.createDataFrame(seeds_of(lists, context), "node_id long, seed double")
    walk = pagerank(walked if walked is not None else nodes, edges, seeds, rounds=rounds, moves=moves).filter("score > 0").join(ids, "node_id", "left_semi").orderBy(F.desc("score"), "node_id").limit(pool)
    anchor = context if context is not None else next((hits[0][0] for hits in lists if hits), None)
    home = membership.filter(F.col("node_id") == anchor).select("community").first() if anchor is not None else None
    near = proximity(edges, membership, home[0]).filter("score > 0").join(ids, "node_id", "left_semi").orderBy(F.desc("score"), "node_id").limit(pool) if home else None
    lists += [order(walk.collect()), order(near.collect()) if near is not None else []]
    streams = spark.createDataFrame([(number, pos, *row) for number, hits in enumerate(lists) for pos, row in enumerate(hits)], "stream int, pos int, id long, score double")
    tie = structural.withColumnRenamed("node_id", "id") if structural is not None else None
    best = best_fused(fuse(streams.coalesce(1), 4, settings, tie), k)
    return best.join(found, best["id"] == found["node_id"]).select("position", "node_id", "name", "kind", "fused", "contributions", "raw")


def node_texts(nodes: DataFrame) -> DataFrame:
    """node_id and the text that is embedded of each searchable node."""
    rows = searchable(nodes).filter("node_id is not null").dropDuplicates(["node_id"])
    return rows.select("node_id", searchable_text(F.col("tracker_id"), F.col("name"), F.col("kind"), F.col("source")).alias("text"))
