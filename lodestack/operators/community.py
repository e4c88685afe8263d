"""Communities of the graph and how near each node is to one of them."""

from __future__ import annotations

import math
import tempfile
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .graph import COMMUNITY_WEIGHTS, clean_edges, dense_ids, kind_weight

SMALL_EDGES = 200_000
SWEEPS = 100


def undirected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """a <= b, w: parallel and opposite edges added; a = b is a self loop."""
    rows = clean_edges(edges, nodes, loops=True).withColumn("w", kind_weight(F.col("kind"), COMMUNITY_WEIGHTS)).filter("w > 0")
    return rows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, small_edges: int = SMALL_EDGES, sweeps: int = SWEEPS) -> DataFrame:
    """node_id, community (numbered from 0 by the first node that has it).

    Nodes move in the order of ids, one after the other, to the neighbouring community that gains most, then
    communities are split into their connected parts. ``small_edges`` only says where that is done: a graph of
    at most so many pairs in the driver, a larger one in one task that keeps its links in a file, with the
    same result. A graph that is still moving after ``sweeps`` rounds raises an error.
    """
    spark = nodes.sparkSession
    ids = nodes.select("node_id").dropna().distinct()
    pairs = cut(undirected(edges, nodes))
    if pairs.count() <= small_edges and ids.count() <= small_edges:
        found = sequential(sorted(r[0] for r in ids.collect()), [tuple(r) for r in pairs.collect()], resolution, sweeps)
        return spark.createDataFrame(list(found.items()), "node_id long, community long")
    moved = cut(_in_one_task(ids, pairs, resolution, sweeps))
    parts = cut(connected(ids, pairs, moved))
    # a part is named by its first node, so ranking the parts numbers them by first nodes
    label = dense_ids(parts.select("part").distinct(), ["part"]).withColumnRenamed("dense_id", "community")
    return parts.join(label, "part").select("node_id", "community")


def local_moving(begin: np.ndarray, other: np.ndarray, weight: np.ndarray, resolution: float = 1.0, sweeps: int = SWEEPS) -> array:
    """The community of every node after moving in order: links of node i are those from begin[i] to begin[i + 1].

    A link of a node to itself is a loop. Besides the links, which may be mapped files, it takes four numbers a node.
    """
    count = len(begin) - 1
    degree, loop = array("d", bytes(8 * count)), array("d", bytes(8 * count))

    def links_of(i: int) -> zip:
        return zip(other[begin[i] : begin[i + 1]].tolist(), weight[begin[i] : begin[i + 1]].tolist())

    def plain() -> Iterator[float]:
        for i in range(count):
            apart = [w for j, w in links_of(i) if j != i]
            loop[i] = sum(w for j, w in links_of(i) if j == i)
            degree[i] = sum(apart) + loop[i]
            yield from apart

    twice = max(2.0 * (math.fsum(plain()) / 2 + math.fsum(loop)), 5e-324)
    home, total = array("q", range(count)), array("d", degree)
    for _ in range(sweeps):
        changed = False
        for i in range(count):
            old, own = home[i], degree[i]
            total[old] -= own
            links: dict[int, float] = defaultdict(float)
            for j, w in links_of(i):
                if j != i:
                    links[home[j]] += w
            if loop[i] > 0:
                links[old] += loop[i]
            best, gain = old, float("-inf")
            for c in sorted(links):
                g = links[c] - resolution * total[c] * own / twice
                if g > gain + 1e-12:
                    best, gain = c, g
            total[best] += own
            if best != old:
                home[i], changed = best, True
        if not changed:
            return home
    if not count:
        return home
    raise RuntimeError(f"communities still move after {sweeps} sweeps over {count} nodes")


def sequential(ids: list[int], pairs: list[tuple[int, int, float]], resolution: float = 1.0, sweeps: int = SWEEPS) -> dict[int, int]:
    """Local moving in order of ids and the split into connected parts, for graphs that fit one process."""
    near: dict[int, list[tuple[int, float]]] = {i: [] for i in ids}
    for a, b, w in sorted(pairs):
        near[a].append((b, w))
        if a != b:
            near[b].append((a, w))
    at = {i: n for n, i in enumerate(ids)}
    begin = np.cumsum([0, *(len(near[i]) for i in ids)])
    other = np.array([at[j] for i in ids for j, _ in near[i]], dtype=np.int64)
    weight = np.array([w for i in ids for _, w in near[i]], dtype=np.float64)
    moved = local_moving(begin, other, weight, resolution, sweeps)
    home = {i: moved[n] for n, i in enumerate(ids)}
    # every part gets the number of its first node, in order of first nodes
    label: dict[int, int] = {}
    count = 0
    for i in ids:
        if i in label:
            continue
        stack, label[i] = [i], count
        while stack:
            at = stack.pop()
            for j, _ in near[at]:
                if j not in label and home[j] == home[i]:
                    label[j] = count
                    stack.append(j)
        count += 1
    return label


def _in_one_task(ids: DataFrame, pairs: DataFrame, resolution: float, sweeps: int) -> DataFrame:
    """node_id, community (named by one of its nodes) of :func:`local_moving`, links sorted by Spark and kept in files."""
    links = pairs.select(F.col("a").alias("node_id"), F.col("b").alias("other"), "w")
    back = pairs.filter("a <> b").select(F.col("b").alias("node_id"), F.col("a").alias("other"), "w")
    alone = ids.select("node_id", F.col("node_id").alias("other"), F.lit(0.0).alias("w"))
    rows = links.unionByName(back).unionByName(alone).repartition(1).sortWithinPartitions("node_id", "other")

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, begin, size = array("q"), array("q"), 0
        with tempfile.TemporaryFile() as others, tempfile.TemporaryFile() as weights:
            for batch in batches:
                node = batch["node_id"].to_numpy(np.int64)
                first = np.flatnonzero(np.diff(node, prepend=names[-1] if names else node[:1] - 1))
                names.frombytes(node[first].tobytes())
                begin.frombytes((first + size).astype(np.int64).tobytes())
                others.write(batch["other"].to_numpy(np.int64).tobytes())
                weights.write(batch["w"].to_numpy(np.float64).tobytes())
                size += len(node)
            if not size:
                return
            begin.append(size)
            others.flush()
            weights.flush()
            name = np.frombuffer(names, dtype=np.int64)
            other = np.asarray(np.memmap(others, dtype=np.int64, mode="r+"))
            for at in range(0, size, 1_000_000):
                other[at : at + 1_000_000] = np.searchsorted(name, other[at : at + 1_000_000])
            weight = np.asarray(np.memmap(weights, dtype=np.float64, mode="r"))
            home = np.frombuffer(local_moving(np.frombuffer(begin, dtype=np.int64), other, weight, resolution, sweeps), dtype=np.int64)
            for at in range(0, len(name), 100_000):
                yield pd.DataFrame({"node_id": name[at : at + 100_000], "community": name[home[at : at + 100_000]]})

    return rows.mapInPandas(move, "node_id long, community long")


def connected(ids: DataFrame, pairs: DataFrame, home: DataFrame) -> DataFrame:
    """node_id, part: the smallest node of its connected part within its community; rounds of smallest labels."""
    own = home.select(F.col("node_id").alias("a"), F.col("community").alias("ca"))
    other = home.select(F.col("node_id").alias("b"), F.col("community").alias("cb"))
    inside = pairs.filter("a <> b").join(own, "a").join(other, "b").filter("ca = cb").select("a", "b")
    links = cut(inside.unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    part = cut(ids.withColumn("part", F.col("node_id")))
    while True:
        near = links.join(part, links["b"] == part["node_id"]).groupBy("a").agg(F.min("part").alias("near"))
        stepped = part.join(near, part["node_id"] == near["a"], "left").select("node_id", "part", F.least("part", "near").alias("least"))
        # a label's own label is at least as small: following it halves the way
        jump = stepped.select(F.col("node_id").alias("least"), F.col("least").alias("least2"))
        after = cut(stepped.join(jump, "least", "left").select("node_id", F.col("part").alias("was"), F.least("least", "least2").alias("part")))
        if after.filter("part <> was").limit(1).count() == 0:
            return after.select("node_id", "part")
        part = after.drop("was")


def modularity(nodes: DataFrame, edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a membership (node_id, community)."""
    pairs = undirected(edges, nodes)
    member = membership.select("node_id", "community")
    a = member.select(F.col("node_id").alias("a"), F.col("community").alias("ca"))
    b = member.select(F.col("node_id").alias("b"), F.col("community").alias("cb"))
    rows = pairs.join(a, "a").join(b, "b")
    ends = rows.select("ca", "w", (F.col("ca") == F.col("cb")).alias("inside")).withColumnRenamed("ca", "community").withColumn("twice", F.when(F.col("inside"), F.col("w")).otherwise(0.0))
    more = rows.filter("a <> b").select(F.col("cb").alias("community"), "w", (F.col("ca") == F.col("cb")).alias("inside")).withColumn("twice", F.when(F.col("inside"), F.col("w")).otherwise(0.0))
    each = ends.unionByName(more).groupBy("community").agg(F.sum("twice").alias("inside"), F.sum("w").alias("degree"))
    whole = each.agg(F.sum("degree").alias("m2"))
    return each.crossJoin(F.broadcast(whole)).agg(F.round(F.coalesce(F.sum(F.col("inside") / F.col("m2") - resolution * F.pow(F.col("degree") / F.col("m2"), 2)), F.lit(0.0)), 6).alias("modularity"))


def proximity(edges: DataFrame, membership: DataFrame, community: int) -> DataFrame:
    """node_id, score: 1 inside, up to a half in communities joined to it, 0 elsewhere.

    How strongly two communities are joined is the summed weight of all directed edges between them, as a
    share of the strongest pair of all.
    """
    member = membership.select("node_id", "community")
    s = member.select(F.col("node_id").alias("src"), F.col("community").alias("cs"))
    d = member.select(F.col("node_id").alias("dst"), F.col("community").alias("cd"))
    rows = edges.select("src", "dst", kind_weight(F.col("kind"), COMMUNITY_WEIGHTS).alias("w")).join(s, "src").join(d, "dst").filter("cs <> cd")
    between = rows.groupBy(F.least("cs", "cd").alias("x"), F.greatest("cs", "cd").alias("y")).agg(F.sum("w").alias("w"))
    strongest = F.broadcast(between.agg(F.max("w").alias("most")))
    near = between.filter((F.col("x") == community) | (F.col("y") == community)).crossJoin(strongest).select(F.when(F.col("x") == community, F.col("y")).otherwise(F.col("x")).alias("community"), (F.col("w") / F.col("most") * 0.5).alias("near"))
    score = F.when(F.col("community") == community, F.lit(1.0)).otherwise(F.round(F.coalesce("near", F.lit(0.0)), 6))
    return member.join(near, "community", "left").select("node_id", score.alias("score"))


def members(membership: DataFrame, community: int) -> DataFrame:
    return membership.filter(F.col("community") == community).select("node_id")
