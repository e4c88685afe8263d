"""Queries of graph statistics, walks and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, graph, pagerank
from ..runtime import table

ROUNDS = 5
SETTLED = {"rounds": 300, "epsilon": 1e-14}  #: walks that are followed until nothing moves any more
START, HOME, PARTS = 37, 3, 16
NAME = "Entry"


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "nodes"), table(spark, folder, "edges")


def _labels(nodes: DataFrame) -> DataFrame:
    """A fixed membership, so that what follows from one can be compared exactly."""
    return nodes.select("node_id").dropna().distinct().withColumn("community", F.pmod("node_id", F.lit(PARTS)))


def edge_kind_stats(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_kind_stats(graph.clean_edges(*reversed(_graph(spark, folder))))


def dependency_scores(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dependency_scores(*_graph(spark, folder))


def top_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.top_nodes(_graph(spark, folder)[0], 20)


def node_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbourhood(*_graph(spark, folder), START)


def node_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_graph(spark, folder)[1])


def named_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of one name."""
    return graph.by_name(graph.distinct_nodes(_graph(spark, folder)[0]), NAME).select("node_id", "kind", "tracker_id")


def searchable_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return graph.searchable(graph.distinct_nodes(_graph(spark, folder)[0])).groupBy("kind").agg(F.count("*").alias("nodes"))


def community_members(spark: SparkSession, folder: str) -> DataFrame:
    return community.members(_labels(_graph(spark, folder)[0]), HOME)


def graph_document(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that come back from the graph's document."""
    return graph.edges_of_document(graph.graph_document(*_graph(spark, folder)))


def bfs_reachable(spark: SparkSession, folder: str) -> DataFrame:
    edges = _graph(spark, folder)[1]
    start = spark.createDataFrame([(START,)], "node_id long")
    return graph.reachable(edges, start, limit=None).select("node_id")


def bfs_bounded(spark: SparkSession, folder: str) -> DataFrame:
    edges = _graph(spark, folder)[1]
    return graph.reachable(edges, spark.createDataFrame([(START,)], "node_id long"), kinds=graph.KINDS)


def _scores(found: DataFrame) -> DataFrame:
    return found.select("node_id", F.round("score", 9).alias("score"))


def ppr_uniform(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(pagerank.pagerank(*_graph(spark, folder), rounds=ROUNDS, epsilon=1e-15))


def ppr_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The same rounds as joins, as a large graph takes them."""
    return _scores(pagerank.pagerank(*_graph(spark, folder), rounds=ROUNDS, epsilon=1e-15, small_edges=0))


def ppr_seeded(spark: SparkSession, folder: str) -> DataFrame:
    seeds = spark.createDataFrame([(START, 3.0), (HOME, 1.0)], "node_id long, seed double")
    return _scores(pagerank.pagerank(*_graph(spark, folder), seeds, rounds=ROUNDS, epsilon=1e-15))


def pagerank_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Only the heaviest of several kinds of edges between two nodes counts."""
    return _scores(pagerank.pagerank(*_graph(spark, folder), rounds=ROUNDS, epsilon=1e-15, collapse=True))


def pagerank_converged(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(pagerank.pagerank(*_graph(spark, folder), **SETTLED))


def pagerank_module_seeds(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _graph(spark, folder)
    seeds = pagerank.module_seeds(nodes, ["anchor::gate_3", "anchor"], 0.5)
    return _scores(pagerank.pagerank(nodes, edges, seeds, **SETTLED))


def pagerank_degree_seeds(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _graph(spark, folder)
    return _scores(pagerank.pagerank(nodes, edges, pagerank.degree_seeds(edges), **SETTLED))


def pagerank_foundational_seeds(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _graph(spark, folder)
    return _scores(pagerank.pagerank(nodes, edges, pagerank.foundational_seeds(nodes, edges), **SETTLED))


def node_communities(spark: SparkSession, folder: str) -> DataFrame:
    return community.communities(*_graph(spark, folder))


def undirected_weights(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _graph(spark, folder)
    return community.undirected(edges, nodes).select("a", "b", F.round("w", 6).alias("w"))


def community_proximity(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _graph(spark, folder)
    return community.proximity(graph.clean_edges(edges, nodes, loops=True), _labels(nodes), HOME)


def label_modularity(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _graph(spark, folder)
    return community.modularity(nodes, edges, _labels(nodes))


QUERIES = {
    f.__name__: f
    for f in (edge_kind_stats, dependency_scores, top_nodes, node_neighbourhood, node_degrees, named_nodes, searchable_kinds, community_members, graph_document, bfs_reachable, bfs_bounded, ppr_uniform, ppr_joined, ppr_seeded, pagerank_collapsed, pagerank_converged, pagerank_module_seeds, pagerank_degree_seeds, pagerank_foundational_seeds, node_communities, undirected_weights, community_proximity, label_modularity)
}


def weights_sql(table_: dict[str, float]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in table_.items()) + " END"


_CLEAN = """ids AS (SELECT DISTINCT node_id FROM nodes WHERE node_id IS NOT NULL),
        clean AS (SELECT DISTINCT src, dst, kind FROM edges WHERE src <> dst AND src IN (SELECT node_id FROM ids) AND dst IN (SELECT node_id FROM ids))"""


def walk_steps(restart: str, before: str = "", collapse: bool = False) -> str:
    """Named tables of the walk from ``restart``, the last one of which is r with the number of rounds."""
    rounds = []
    for i in range(ROUNDS):
        rounds.append(f"m{i} AS MATERIALIZED (SELECT dst AS node_id, 0.85 * sum(score * share) AS mass FROM r{i} JOIN moves ON node_id = src GROUP BY dst)")
        rounds.append(f"r{i + 1} AS MATERIALIZED (SELECT node_id, sum(mass) AS score FROM (SELECT * FROM m{i} UNION ALL SELECT node_id, seed * (1 - coalesce((SELECT sum(mass) FROM m{i}), 0)) FROM restart) GROUP BY node_id)")
    return f"""{_CLEAN},
        pairs AS (SELECT src, dst, {"max" if collapse else "sum"}({weights_sql(graph.WALK_WEIGHTS)}) AS w FROM clean GROUP BY ALL),
        moves AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM pairs),
        {before + "," if before else ""}
        restart AS MATERIALIZED ({restart}),
        r0 AS (SELECT node_id, seed AS score FROM restart),
        {", ".join(rounds)}"""


def _walk_sql(seeds: str, collapse: bool = False) -> str:
    return f"WITH {walk_steps(seeds, collapse=collapse)} SELECT node_id, round(coalesce(score, 0), 9) AS score FROM ids LEFT JOIN r{ROUNDS} USING (node_id)"


def _settled_sql(seeds: str, rounds: int = 250) -> str:
    """``seeds``: node_id and seed of existing nodes, not yet summing to one."""
    return f"""
        WITH RECURSIVE {_CLEAN},
        pairs AS (SELECT src, dst, sum({weights_sql(graph.WALK_WEIGHTS)}) AS w FROM clean GROUP BY ALL),
        moves AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM pairs),
        restart AS MATERIALIZED (SELECT node_id, seed / sum(seed) OVER () AS seed FROM ({seeds})),
        r(node_id, score, i) AS (
            SELECT node_id, seed, 0 FROM restart
            UNION ALL
            SELECT node_id, coalesce(mass, 0) + coalesce(seed, 0) * (1 - coalesce(sum(mass) OVER (), 0)), max(i) OVER () + 1
            FROM (SELECT dst AS node_id, 0.85 * sum(score * share) AS mass, max(i) AS i FROM r JOIN moves ON r.node_id = src GROUP BY dst) FULL JOIN restart USING (node_id)
            QUALIFY max(i) OVER () < {rounds}
        )
        SELECT node_id, round(coalesce(score, 0), 9) AS score FROM ids LEFT JOIN (SELECT node_id, score FROM r WHERE i = {rounds}) USING (node_id)
    """


_MODULE = "CASE WHEN list_extract(p, 1) = 'crate' THEN p[2:len(p) - 2] ELSE p[1:len(p) - 2] END"
_ALL = "SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS seed FROM ids"
_SCORE = "SELECT node_id, round(coalesce(s, 0.0), 6) AS score FROM ids LEFT JOIN (SELECT dst AS node_id, sum(CASE kind WHEN 'calls' THEN 1.0 ELSE 0.7 END)::DOUBLE AS s FROM (SELECT DISTINCT src, dst, kind FROM edges WHERE src <> dst AND kind IN ('calls', 'references')) GROUP BY dst) USING (node_id)"

SQL = {
    "edge_kind_stats": f"WITH {_CLEAN} SELECT kind, count(*) AS edges FROM clean GROUP BY kind",
    "graph_document": f"WITH {_CLEAN} SELECT src, dst, kind FROM clean",
    "dependency_scores": f"WITH ids AS (SELECT DISTINCT node_id FROM nodes WHERE node_id IS NOT NULL) {_SCORE}",
    "top_nodes": """
        WITH one AS (SELECT node_id, name, pagerank FROM nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY tracker_id NULLS LAST) = 1)
        SELECT node_id, name, pagerank FROM one WHERE pagerank IS NOT NULL AND NOT isnan(pagerank) ORDER BY pagerank DESC, node_id LIMIT 20
    """,
    "node_neighbourhood": f"""
        WITH clean AS (SELECT DISTINCT src, dst, kind FROM edges WHERE src <> dst),
        names AS (SELECT node_id, name FROM nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY tracker_id NULLS LAST) = 1),
        ends AS (SELECT 'out' AS direction, dst AS node_id, kind FROM clean WHERE src = {START} UNION ALL SELECT 'in', src, kind FROM clean WHERE dst = {START})
        SELECT direction, node_id, name, kind FROM ends LEFT JOIN names USING (node_id)
    """,
    "named_nodes": f"SELECT node_id, kind, tracker_id FROM (SELECT * FROM nodes WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY tracker_id NULLS LAST) = 1) WHERE name = '{NAME}'",
    "searchable_kinds": f"SELECT kind, count(DISTINCT node_id) AS nodes FROM nodes WHERE node_id IS NOT NULL AND kind IN ({', '.join(repr(k) for k in graph.SEARCHABLE)}) GROUP BY kind",
    "community_members": f"SELECT DISTINCT node_id FROM nodes WHERE node_id % {PARTS} = {HOME}",
    "node_degrees": """
        WITH clean AS (SELECT DISTINCT src, dst, kind FROM edges WHERE src <> dst)
        SELECT node_id, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing FROM (SELECT src AS node_id, 0 AS i, 1 AS o FROM clean UNION ALL SELECT dst, 1, 0 FROM clean) GROUP BY node_id
    """,
    "bfs_reachable": f"""
        WITH RECURSIVE links AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND kind IN ('calls', 'references')),
        seen(node_id) AS (SELECT {START}::BIGINT UNION SELECT dst FROM seen JOIN links ON src = node_id)
        SELECT node_id FROM seen
    """,
    "ppr_uniform": _walk_sql(_ALL),
    "ppr_joined": _walk_sql(_ALL),
    "ppr_seeded": _walk_sql(f"SELECT node_id, CASE node_id WHEN {START} THEN 3.0 ELSE 1.0 END / sum(CASE node_id WHEN {START} THEN 3.0 ELSE 1.0 END) OVER () AS seed FROM ids WHERE node_id IN ({START}, {HOME})"),
    "pagerank_collapsed": _walk_sql(_ALL, collapse=True),
    "pagerank_converged": _settled_sql("SELECT node_id, 1.0::DOUBLE AS seed FROM ids"),
    "pagerank_degree_seeds": _settled_sql("SELECT node_id, count(*)::DOUBLE AS seed FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) JOIN ids USING (node_id) GROUP BY node_id"),
    "pagerank_foundational_seeds": _settled_sql("SELECT DISTINCT node_id, 1.0::DOUBLE AS seed FROM (SELECT node_id FROM nodes WHERE kind = 'trait' UNION ALL SELECT dst FROM edges WHERE kind = 'implements') JOIN ids USING (node_id)"),
    "pagerank_module_seeds": _settled_sql(f"""
        SELECT node_id, max(greatest(pow(0.5, 2 - CASE WHEN m[1:2] = ['anchor', 'gate_3'] THEN 2 WHEN m[1:1] = ['anchor'] THEN 1 ELSE 0 END), pow(0.5, 1 - CASE WHEN m[1:1] = ['anchor'] THEN 1 ELSE 0 END))) AS seed
        FROM (SELECT node_id, {_MODULE} AS m FROM (SELECT node_id, string_split(tracker_id, '::') AS p FROM nodes WHERE node_id IS NOT NULL AND tracker_id IS NOT NULL)) GROUP BY node_id
    """),
    "bfs_bounded": f"""
        WITH RECURSIVE links AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
        seen(node_id, d) AS (SELECT {START}::BIGINT, 0 UNION SELECT dst, d + 1 FROM seen JOIN links ON src = node_id WHERE d < 16),
        near AS (SELECT node_id, min(d) AS distance FROM seen GROUP BY node_id),
        rounds AS (SELECT distance, coalesce(sum(count(*)) OVER (ORDER BY distance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM near GROUP BY distance)
        SELECT node_id, distance FROM near JOIN rounds USING (distance) WHERE before < 512
    """,
    "undirected_weights": f"""
        WITH ids AS (SELECT DISTINCT node_id FROM nodes WHERE node_id IS NOT NULL),
        clean AS (SELECT DISTINCT src, dst, kind FROM edges WHERE src IN (SELECT node_id FROM ids) AND dst IN (SELECT node_id FROM ids))
        SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(sum(w)::DOUBLE, 6) AS w FROM (SELECT *, {weights_sql(graph.COMMUNITY_WEIGHTS)} AS w FROM clean) WHERE w > 0 GROUP BY 1, 2
    """,
    "community_proximity": f"""
        WITH ids AS (SELECT DISTINCT node_id, node_id % {PARTS} AS c FROM nodes WHERE node_id IS NOT NULL),
        clean AS (SELECT DISTINCT src, dst, kind FROM edges),
        rows AS (SELECT s.c AS cs, d.c AS cd, {weights_sql(graph.COMMUNITY_WEIGHTS)} AS w FROM clean JOIN ids s ON src = s.node_id JOIN ids d ON dst = d.node_id WHERE s.c <> d.c),
        between_ AS (SELECT least(cs, cd) AS x, greatest(cs, cd) AS y, sum(w)::DOUBLE AS w FROM rows GROUP BY 1, 2),
        near AS (SELECT CASE WHEN x = {HOME} THEN y ELSE x END AS c, w / (SELECT max(w) FROM between_) * 0.5 AS near FROM between_ WHERE x = {HOME} OR y = {HOME})
        SELECT node_id, CASE WHEN c = {HOME} THEN 1.0 ELSE round(coalesce(near, 0), 6) END AS score FROM ids LEFT JOIN near USING (c)
    """,
    "label_modularity": f"""
        WITH ids AS (SELECT DISTINCT node_id, node_id % {PARTS} AS c FROM nodes WHERE node_id IS NOT NULL),
        clean AS (SELECT DISTINCT src, dst, kind FROM edges),
        pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum({weights_sql(graph.COMMUNITY_WEIGHTS)})::DOUBLE AS w FROM clean WHERE src IN (SELECT node_id FROM ids) AND dst IN (SELECT node_id FROM ids) GROUP BY 1, 2),
        ends AS (SELECT x.c AS c, w, x.c = y.c AS i FROM pairs JOIN ids x ON a = x.node_id JOIN ids y ON b = y.node_id UNION ALL
                 SELECT y.c, w, x.c = y.c FROM pairs JOIN ids x ON a = x.node_id JOIN ids y ON b = y.node_id WHERE a <> b),
        each AS (SELECT c, sum(CASE WHEN i THEN w ELSE 0 END) AS inside, sum(w) AS degree FROM ends GROUP BY c)
        SELECT round(sum(inside / m2 - pow(degree / m2, 2)), 6) AS modularity FROM each, (SELECT sum(degree) AS m2 FROM each)
    """,
}
