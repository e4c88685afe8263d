"""Personalized PageRank as rounds of joins, or in numpy for a graph of checked small size."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, release
from .graph import WALK_WEIGHTS, clean_edges, kind_weight

SMALL_EDGES = 200_000


def transitions(edges: DataFrame, nodes: DataFrame, weights: dict[str, float] | None = None, collapse: bool = False) -> DataFrame:
    """src, dst, share: where a walker goes from each node; edges without positive finite weight are dropped.

    Kinds between the same two nodes add up, or with ``collapse`` only the heaviest counts.
    """
    weighted = clean_edges(edges, nodes).withColumn("w", kind_weight(F.col("kind"), weights)).filter("w > 0 and w < double('infinity')")
    pairs = weighted.groupBy("src", "dst").agg((F.max("w") if collapse else F.sum("w")).alias("w"))
    total = pairs.groupBy("src").agg(F.sum("w").alias("total"))
    return pairs.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share"))


def seed_vector(nodes: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """node_id, seed summing to one: the given positive finite seeds of existing nodes, or all nodes alike."""
    ids = nodes.select("node_id").dropna().distinct()
    if seeds is not None:
        own = seeds.filter("seed > 0 and seed < double('infinity')").groupBy("node_id").agg(F.sum("seed").alias("seed")).join(ids, "node_id", "left_semi")
        total = own.agg(F.sum("seed")).first()[0]
        if total:
            return own.select("node_id", (F.col("seed") / F.lit(total)).alias("seed"))
    count = ids.count()
    return ids.withColumn("seed", F.lit(1.0 / count if count else 0.0))


def foundational_seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Traits and whatever is implemented."""
    traits = nodes.filter(F.col("kind") == "trait").select("node_id")
    return traits.union(edges.filter(F.col("kind") == "implements").select("dst")).dropna().distinct().withColumn("seed", F.lit(1.0))


def module_seeds(nodes: DataFrame, modules: list[str], decay: float) -> DataFrame:
    """decay to the number of segments of a seed module that a node's module path doesn't share; best module counts."""
    parts = F.split("tracker_id", "::")
    skip = F.when(F.element_at(parts, 1) == "crate", 1).otherwise(0)
    module = F.slice(parts, skip + 1, F.greatest(F.size(parts) - 2 - skip, F.lit(0)))
    best = F.lit(0.0)
    for name in modules:
        wanted = name.split("::")
        same = F.lit(0)
        for depth in range(len(wanted), 0, -1):
            same = F.when(F.slice(module, 1, depth) == F.array(*(F.lit(w) for w in wanted[:depth])), F.lit(depth)).otherwise(same) if depth == len(wanted) else F.when(same > 0, same).when(F.slice(module, 1, depth) == F.array(*(F.lit(w) for w in wanted[:depth])), F.lit(depth)).otherwise(F.lit(0))
        best = F.greatest(best, F.pow(F.lit(float(decay)), F.lit(len(wanted)) - same))
    return nodes.filter("node_id is not null and tracker_id is not null").select("node_id", best.alias("seed")).groupBy("node_id").agg(F.max("seed").alias("seed"))


def degree_seeds(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).dropna()
    return ends.groupBy("node_id").agg(F.greatest(F.count("*").cast("double"), F.lit(0.01)).alias("seed"))


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame | None = None,
    damping: float = 0.85,
    rounds: int = 100,
    epsilon: float = 1e-8,
    weights: dict[str, float] | None = None,
    collapse: bool = False,
    small_edges: int = SMALL_EDGES,
    moves: DataFrame | None = None,
) -> DataFrame:
    """node_id, score of every node; scores sum to one. ``moves``: :func:`transitions` that were made before.

    Mass of nodes without outgoing edges goes where walkers restart. Bad settings become the defaults. The
    rounds stop when scores change by less than ``epsilon`` in sum; when ``rounds`` end before that, the scores
    of the last one are given and a warning tells the change that was left. A graph without nodes gives no rows.
    """
    damping = min(max(damping, 0.0), 0.99) if math.isfinite(damping) else 0.85
    epsilon = max(epsilon, 1e-15) if math.isfinite(epsilon) else 1e-8
    rounds = max(int(rounds), 1)
    moves = moves if moves is not None else cut(transitions(edges, nodes, weights or WALK_WEIGHTS, collapse))
    restart = cut(seed_vector(nodes, seeds))
    ids = nodes.select("node_id").dropna().distinct()
    if moves.count() <= small_edges and restart.count() <= small_edges:
        return _small(nodes.sparkSession, ids, moves, restart, damping, rounds, epsilon)
    score = restart.withColumnRenamed("seed", "score")
    for _ in range(rounds):
        moved = cut(score.join(moves, score["node_id"] == moves["src"]).groupBy(F.col("dst").alias("node_id")).agg((F.sum(F.col("score") * F.col("share")) * damping).alias("mass")))
        rest = 1.0 - (moved.agg(F.sum("mass")).first()[0] or 0.0)
        both = moved.unionByName(restart.select("node_id", (F.col("seed") * rest).alias("mass")))
        after = cut(both.groupBy("node_id").agg(F.sum("mass").alias("score")))
        change = after.withColumnRenamed("score", "new").join(score, "node_id", "full_outer").agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))).first()[0]
        release(moved)
        release(score)
        score = after
        if change is None or change < epsilon:
            break
    _warn_unsettled(change, epsilon)
    return ids.join(score, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _warn_unsettled(change: float | None, epsilon: float) -> None:
    if change is not None and change >= epsilon:
        warnings.warn(f"scores still changed by {change:.3g} in the last round", stacklevel=3)


def _small(spark, ids: DataFrame, moves: DataFrame, restart: DataFrame, damping: float, rounds: int, epsilon: float) -> DataFrame:
    """The same rounds over arrays; only reached when both tables were counted to be small."""
    m, r = moves.toPandas(), restart.toPandas()
    known = np.unique(np.concatenate([m["src"], m["dst"], r["node_id"]]).astype(np.int64))
    src, dst, share = np.searchsorted(known, m["src"]), np.searchsorted(known, m["dst"]), m["share"].to_numpy()
    restart_at = np.zeros(len(known))
    restart_at[np.searchsorted(known, r["node_id"])] = r["seed"]
    score = restart_at.copy()
    for _ in range(rounds):
        new = np.bincount(dst, score[src] * share * damping, len(known)) if len(m) else np.zeros(len(known))
        new = new + (1.0 - new.sum()) * restart_at
        change = np.abs(new - score).sum()
        score = new
        if change < epsilon:
            break
    _warn_unsettled(change, epsilon)
    table = spark.createDataFrame([(int(n), float(s)) for n, s in zip(known, score)], "node_id long, score double")
    return ids.join(table, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))
