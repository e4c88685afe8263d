"""One order from several scores of different scales: Borda counts over ranks with averaged ties.

Queries of up to ``large_group`` rows are ranked by windows behind a single exchange by query. In a larger
query no rows of one query meet in one task: equal scores are counted first, its values are cut into buckets
at quantiles, and each value's rank is the rows in better buckets plus the better values of its own bucket.
Both ways are exact and give the same points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, settle

SCORES = ("lexical", "semantic", "structural", "leiden", "pagerank", "rrf_score")
BUCKETS = 64
LARGE_GROUP = 50_000


def long_scores(hits: DataFrame, names: tuple[str, ...] = SCORES) -> DataFrame:
    """query_id, node_id, metric, value from the map ``scores`` and the plain columns; NaN becomes null.

    Of several rows of one node the best value of each score counts. Rows without an id are left out.
    """
    def value(name: str) -> Column:
        column = F.col(name) if name in hits.columns else F.col("scores")[name]
        return F.nanvl(column.cast("double"), F.lit(None).cast("double"))

    best = hits.dropna(subset=["query_id", "node_id"]).groupBy("query_id", "node_id").agg(*(F.max(value(n)).alias(n) for n in names))
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))
    return best.select("query_id", "node_id", F.inline(pairs))


def stream_scores(streams: DataFrame) -> DataFrame:
    """The same long form from ranked lists; of an id listed twice in a list the first counts."""
    rows = streams.dropna(subset=["query_id", "stream", "pos", "id"])
    first = rows.groupBy("query_id", F.col("stream").cast("string").alias("metric"), F.col("id").alias("node_id")).agg(F.min_by("score", "pos").alias("value"))
    return first.select("query_id", "node_id", "metric", F.nanvl(F.col("value"), F.lit(None).cast("double")).alias("value"))


def ranked_values(scores: DataFrame, large_group: int = LARGE_GROUP) -> DataFrame:
    """query_id, metric, value, rank: competition rank of each value, ties averaged, 1 for the highest."""
    counts = settle(scores.filter("value is not null").groupBy("query_id", "metric", "value").agg(F.count("*").alias("n")))
    groups = counts.groupBy("query_id", "metric").agg(F.count("*").alias("values"), F.percentile_approx("value", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts"))
    groups = groups.select("query_id", "metric", F.when(F.col("values") > large_group, F.array_distinct("cuts")).otherwise(F.array().cast("array<double>")).alias("cuts"))
    bucketed = counts.join(groups, ["query_id", "metric"]).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sums = bucketed.groupBy("query_id", "metric", "bucket").agg(F.sum("n").alias("held"))
    above = Window.partitionBy("query_id", "metric").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("above", F.coalesce(F.sum("held").over(above), F.lit(0))).drop("held")
    within = Window.partitionBy("query_id", "metric", "bucket").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    better = F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("above")
    return bucketed.join(sums, ["query_id", "metric", "bucket"]).select("query_id", "metric", "value", (better + (F.col("n") + 1) / 2).alias("rank"))


def _weight(weights: dict[str, float] | None) -> Column:
    return F.lit(1.0) if not weights else F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("metric")), F.lit(1.0))


def _points(nodes: Column, missing: str, metrics: Column, present: Column, own: Column, held: Column, rank: Column) -> Column:
    """Points of a node in a query of ``nodes`` nodes, all sums weighted.

    ``metrics``: of the query's metrics; ``present``: of the values the query's nodes have; ``own``: of the
    node's metrics; ``held``: of how many nodes have each of them; ``rank``: of its ranks.
    """
    if missing == "worst":  # absent ones stand in the middle of the places below those present
        return F.round((metrics * (nodes - 1) - present) / 2 + (own * (nodes + 1) + held) / 2 - rank, 6)
    return F.round(metrics * (nodes - 1) / 2 + own * (nodes + 1) / 2 - rank, 6)


def borda(scores: DataFrame, weights: dict[str, float] | None = None, missing: str = "worst", large_group: int = LARGE_GROUP) -> DataFrame:
    """query_id, node_id, points, position: 1 is best, equal points are ordered by node_id.

    ``scores`` has one row for each query_id, node_id and metric. A score gives a node as many points as the
    query has nodes less the node's rank. A missing score has the mean rank of all places below the present
    ones (``worst``) or the middle rank (``middle``). A score without weight counts 1.
    """
    return _ordered(scores, lambda rows: rows, weights, missing, large_group)


def _ordered(rows: DataFrame, longer, weights: dict[str, float] | None, missing: str, large_group: int) -> DataFrame:
    """Borda positions of ``longer(rows)``; ``rows`` with a query_id are parted by the size of their query first."""
    if missing not in ("worst", "middle"):
        raise ValueError("missing must be worst or middle")
    large = cut(rows.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") > large_group).select("query_id"))
    if large.isEmpty():
        return _by_windows(longer(rows.repartition("query_id")), weights, missing)
    small = _by_windows(longer(rows.join(large, "query_id", "left_anti").repartition("query_id")), weights, missing)
    return small.unionByName(_by_buckets(longer(rows.join(large, "query_id", "left_semi")), weights, missing, large_group))


def _by_windows(scores: DataFrame, weights: dict[str, float] | None, missing: str) -> DataFrame:
    """For queries of bounded size: all that follows the exchange by query needs no other one."""
    by = Window.partitionBy("query_id", "metric")
    down = by.orderBy(F.desc_nulls_last("value"))
    known = F.col("value").isNotNull()
    ranked = scores.select("query_id", "node_id", "metric", "value", F.rank().over(down).alias("place"), F.row_number().over(down).alias("row"), F.count("value").over(by).alias("have"))
    ranked = ranked.withColumn("ties", F.count("*").over(Window.partitionBy("query_id", "metric", "place")))
    own = F.when(known, _weight(weights)).otherwise(0.0)
    sums = ranked.groupBy("query_id", "node_id").agg(
        F.sum(F.when(F.col("row") == 1, _weight(weights)).otherwise(0.0)).alias("metrics"),
        F.sum(own).alias("own"),
        F.sum(own * F.col("have")).alias("held"),
        F.sum(own * (F.col("place") + (F.col("ties") - 1) / 2)).alias("rank"),
    )
    query = Window.partitionBy("query_id")
    whole = sums.withColumns({"nodes": F.count("*").over(query), "all": F.sum("metrics").over(query), "present": F.sum("own").over(query)})
    points = whole.select("query_id", "node_id", _points(F.col("nodes"), missing, F.col("all"), F.col("present"), F.col("own"), F.col("held"), F.col("rank")).alias("points"))
    return points.withColumn("position", F.row_number().over(query.orderBy(F.desc("points"), "node_id")))


def _by_buckets(scores: DataFrame, weights: dict[str, float] | None, missing: str, large_group: int) -> DataFrame:
    """For queries of any size."""
    scores = settle(scores)
    have = scores.groupBy("query_id", "metric").agg(F.count("value").alias("have"))
    ranks = scores.filter("value is not null").join(ranked_values(scores, large_group), ["query_id", "metric", "value"]).join(have, ["query_id", "metric"])
    weight = _weight(weights)
    own = ranks.groupBy("query_id", "node_id").agg(F.sum(weight).alias("own"), F.sum(weight * F.col("have")).alias("held"), F.sum(weight * F.col("rank")).alias("rank"))
    query = have.groupBy("query_id").agg(F.sum(weight).alias("metrics"), F.sum(weight * F.col("have")).alias("present"))
    nodes = scores.select("query_id", "node_id").distinct()
    sizes = nodes.groupBy("query_id").agg(F.count("*").alias("nodes"))
    every = nodes.join(own, ["query_id", "node_id"], "left").fillna(0.0, ["own", "held", "rank"]).join(query.join(sizes, "query_id"), "query_id")
    points = every.select("query_id", "node_id", _points(F.col("nodes"), missing, F.col("metrics"), F.col("present"), F.col("own"), F.col("held"), F.col("rank")).alias("points"))
    return _positions(settle(points), large_group)


def _positions(points: DataFrame, large_group: int) -> DataFrame:
    groups = points.groupBy("query_id").agg(F.count("*").alias("n"), F.percentile_approx("points", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("p"), F.percentile_approx("node_id", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("i"))
    small = F.col("n") <= large_group
    groups = groups.select("query_id", F.when(small, F.array().cast("array<double>")).otherwise(F.array_distinct("p")).alias("p"), F.when(small, F.array().cast("array<bigint>")).otherwise(F.array_distinct("i")).alias("i"))
    # a bucket of points, and within it of ids, as many nodes may have equal points
    rows = points.join(groups, "query_id").select("query_id", "node_id", "points", F.size(F.filter("p", lambda c: c < F.col("points"))).alias("b"), F.size(F.filter("i", lambda c: c < F.col("node_id"))).alias("ib"))
    # buckets at equal points only may be split by id: elsewhere points decide first
    rows = rows.withColumn("key", F.struct(-F.col("points"), F.col("ib")))
    sums = rows.groupBy("query_id", "b", "key").agg(F.count("*").alias("held"))
    bucket = sums.groupBy("query_id", "b").agg(F.sum("held").alias("held"))
    above = Window.partitionBy("query_id").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.select("query_id", "b", F.coalesce(F.sum("held").over(above), F.lit(0)).alias("above"))
    before = Window.partitionBy("query_id", "b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.join(bucket, ["query_id", "b"]).select("query_id", "b", "key", (F.col("above") + F.coalesce(F.sum("held").over(before), F.lit(0))).alias("before"))
    place = Window.partitionBy("query_id", "b", "key").orderBy("node_id")
    return rows.join(sums, ["query_id", "b", "key"]).select("query_id", "node_id", "points", (F.col("before") + F.row_number().over(place)).alias("position"))


def best_nodes(hits: DataFrame, k: int = 3, weights: dict[str, float] | None = None, missing: str = "worst", large_group: int = LARGE_GROUP) -> DataFrame:
    """query_id and node_id of the k best nodes of each query of ``hits``; rows are as :func:`long_scores` takes them."""
    rows = hits.dropna(subset=["query_id", "node_id"])
    return _ordered(rows, long_scores, weights, missing, large_group).filter(F.col("position") <= k).select("query_id", "node_id")
