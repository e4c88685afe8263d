"""The code graph as two tables: building, looking up, statistics, weights.

Nodes have node_id and more; edges have src, dst, kind. Null ids never match. All functions take extra
columns and give only the named ones back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import clash_free, cut

KINDS = ("calls", "contains", "imports", "references", "implements", "field_of", "variant_of", "bridge")
# What an edge carries in random walks and in community detection.
WALK_WEIGHTS = {"calls": 1.0, "references": 0.7, "contains": 0.15, "imports": 0.5, "implements": 0.9, "field_of": 0.25, "variant_of": 0.25, "bridge": 0.6}
COMMUNITY_WEIGHTS = {"calls": 1.0, "references": 0.7, "implements": 0.9, "imports": 0.5, "contains": 0.15, "field_of": 0.25, "variant_of": 0.25, "bridge": 0.3}
SEARCHABLE = ("fn", "function", "struct", "enum", "trait", "impl", "type", "const", "static", "macro", "mod", "module")


def kind_weight(kind: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for kv in (weights or WALK_WEIGHTS).items() for x in kv))
    return F.element_at(table, kind)


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node_id: that with the smallest tracker_id; nodes without id are left out."""
    others = [c for c in nodes.columns if c != "node_id"]
    packed = F.min_by(F.struct(*others), F.struct(F.col("tracker_id").isNull(), "tracker_id")) if "tracker_id" in others else F.first(F.struct(*others))
    return nodes.filter("node_id is not null").groupBy("node_id").agg(packed.alias("row")).select("node_id", "row.*").select(*nodes.columns)


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None, loops: bool = False) -> DataFrame:
    """Distinct src, dst, kind whose ends both exist; self edges only on demand."""
    rows = clash_free(edges, "src", "dst", "kind").filter("src is not null and dst is not null").distinct()
    rows = rows if loops else rows.filter("src <> dst")
    if nodes is not None:
        ids = nodes.select("node_id").distinct()
        rows = rows.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return rows.select("src", "dst", "kind")


def dense_ids(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds dense_id from 0 in the given order, without one task for all: ranges are counted, then numbered."""
    spark = nodes.sparkSession
    ranged = cut(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").count().orderBy("__part").collect()
    start, offsets = 0, []
    for row in counts:
        offsets.append((row["__part"], start))
        start += row["count"]
    offset = spark.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(offset), "__part").withColumn("dense_id", F.col("__start") + number - 1).drop("__part", "__start")


def searchable(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*SEARCHABLE))


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name)


def edge_kind_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("edges"))


def dependency_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, score: summed weights of incoming calls and references, 0 where there are none."""
    weighted = clean_edges(edges).filter(F.col("kind").isin("calls", "references")).groupBy(F.col("dst").alias("node_id")).agg(F.round(F.sum(kind_weight(F.col("kind"))), 6).alias("score"))
    return nodes.select("node_id").dropna().distinct().join(weighted, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """The k nodes of highest stamped pagerank; null and NaN count as none, ties go to the smaller id."""
    score = F.nanvl("pagerank", F.lit(None).cast("double"))
    return distinct_nodes(nodes).select("node_id", "name", score.alias("pagerank")).filter("pagerank is not null").orderBy(F.desc("pagerank"), "node_id").limit(max(k, 0))


def neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """direction, node_id, name, kind of every edge of one node, with the other end's name if it has one."""
    own = clean_edges(edges)
    out = own.filter(F.col("src") == node_id).select(F.lit("out").alias("direction"), F.col("dst").alias("node_id"), "kind")
    into = own.filter(F.col("dst") == node_id).select(F.lit("in").alias("direction"), F.col("src").alias("node_id"), "kind")
    names = distinct_nodes(nodes.select("node_id", "tracker_id", "name")).select("node_id", "name")
    return out.unionByName(into).join(names, "node_id", "left").select("direction", "node_id", "name", "kind")


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, incoming, outgoing over distinct edges."""
    own = clean_edges(edges)
    ends = own.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(own.select(F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node_id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def reachable(edges: DataFrame, start: DataFrame, kinds: tuple[str, ...] = ("calls", "references"), limit: int | None = 512, depth: int = 10_000) -> DataFrame:
    """node_id, distance: breadth first from ``start`` along ``kinds``; stops after the round that passes ``limit``."""
    links = cut(clean_edges(edges).filter(F.col("kind").isin(*kinds)).select("src", "dst").distinct())
    seen = cut(start.select(F.col(start.columns[0]).alias("node_id")).dropna().distinct().withColumn("distance", F.lit(0)))
    front, total = seen, seen.count()
    for step in range(1, depth + 1):
        if limit is not None and total >= limit:
            break
        new = front.join(links, front["node_id"] == links["src"]).select(F.col("dst").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        front = cut(new.withColumn("distance", F.lit(step)))
        grown = front.count()
        if not grown:
            break
        total += grown
        seen = cut(seen.unionByName(front))
    return seen


def graph_document(nodes: DataFrame, edges: DataFrame, page_edges: int = 50_000) -> DataFrame:
    """node_id, page, name, kind and sorted incoming and outgoing edges as JSON text: equal graphs give equal texts.

    A node with more than ``page_edges`` edges on one side has several pages, told by a hash of the edge.
    """
    own = clean_edges(edges, nodes)
    def side(key: str, other: str, name: str) -> DataFrame:
        pages = own.groupBy(F.col(key).alias("node_id")).agg(F.ceil(F.count("*") / page_edges).alias("pages"))
        paged = own.select(F.col(key).alias("node_id"), F.col(other).alias("node"), "kind").join(pages, "node_id").withColumn("page", F.pmod(F.xxhash64("node", "kind"), F.col("pages")))
        return paged.groupBy("node_id", "page").agg(F.to_json(F.sort_array(F.collect_list(F.struct("node", "kind")))).alias(name))
    rows = distinct_nodes(nodes.select("node_id", "tracker_id", "name", "kind")).select("node_id", "name", "kind")
    sides = side("dst", "src", "incoming").join(side("src", "dst", "outgoing"), ["node_id", "page"], "full_outer")
    out = rows.join(sides, "node_id", "left")
    return out.select("node_id", F.coalesce("page", F.lit(0)).alias("page"), "name", "kind", F.coalesce("incoming", F.lit("[]")).alias("incoming"), F.coalesce("outgoing", F.lit("[]")).alias("outgoing"))


def edges_of_document(document: DataFrame) -> DataFrame:
    """The distinct edges that a graph document names, self edges dropped."""
    shape = "array<struct<node: bigint, kind: string>>"
    out = document.select(F.col("node_id").alias("src"), F.inline(F.from_json("outgoing", shape))).select("src", F.col("node").alias("dst"), "kind")
    into = document.select(F.col("node_id").alias("dst"), F.inline(F.from_json("incoming", shape))).select(F.col("node").alias("src"), "dst", "kind")
    return clean_edges(out.unionByName(into.select("src", "dst", "kind")))
