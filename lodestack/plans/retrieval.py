"""Queries of lexical, trigram and vector search and of fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import query_terms
from ..functions.vectors import fallback_embedding, mock_embedding
from ..operators import fusion, graph, lexical
from ..runtime import settle, table
from .graphs import PARTS, ROUNDS, walk_steps, weights_sql

QUERY = "loadRegistry merge_budget shard"
NAME_QUERY = "merge_budget"
TRIGRAM_QUERY = "the token budget is stable"


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.lexical_search(table(spark, folder, "postings"), QUERY, 20)
    return found.select("node_id", F.round("score", 6).alias("score"))


def query_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Query words of every item of the test set."""
    rows = table(spark, folder, "eval_items").select("item_id", query_terms(F.col("text")).alias("terms"))
    return rows.select("item_id", F.size("terms").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def trigram_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.trigram_search(table(spark, folder, "documents"), TRIGRAM_QUERY, 20, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.round("jaccard", 6).alias("jaccard"), "score")


def trigram_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and occurrences of every trigram of the names of nodes."""
    return _gram_counts(table(spark, folder, "nodes"), "name")


def trigram_source_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and occurrences of every trigram of the whole sources of nodes."""
    return _gram_counts(table(spark, folder, "nodes"), "source")


def _gram_counts(nodes: DataFrame, column: str) -> DataFrame:
    index = lexical.trigram_index(nodes.select("node_id", column).distinct(), "node_id", column)
    return index.groupBy("gram").agg(F.count("*").alias("chunks"), F.sum("n").alias("occurrences"))


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id is divisible by 50, itself among them."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = fusion.semantic_block(vectors, vectors.filter("vec_id % 50 = 0"), 10, id_column="vec_id")
    return found.select("query", F.col("node_id").alias("vec_id"), F.round("score", 4).alias("score"), "rank")


def trigram_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes nearest by name, read from an index after some names were replaced and others removed."""
    names = table(spark, folder, "nodes").select("node_id", "name").dropna().distinct()
    index = settle(lexical.trigram_index(names, "node_id", "name"))
    renamed = names.filter("node_id % 10 = 1").select("node_id", F.concat("name", F.lit("_budget")).alias("name"))
    index = settle(lexical.remove_chunks(lexical.replace_chunks(index, renamed, id_column="node_id", text_column="name"), names.filter("node_id % 10 = 2").select("node_id")))
    found = lexical.index_search(index, lexical.gram_sizes(index), NAME_QUERY, 20)
    return found.select(F.col("id").alias("node_id"), F.round("jaccard", 6).alias("jaccard"), "score")


def _fused(spark: SparkSession, folder: str, settings: fusion.FusionSettings) -> DataFrame:
    best = fusion.best_fused(fusion.fuse(table(spark, folder, "streams"), 4, settings, keys=("query_id",)), 10, ("query_id",))
    return best.select("query_id", F.col("position").cast("long").alias("position"), "id", F.round("fused", 9).alias("fused"))


def rrf_four_streams(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, fusion.FusionSettings())


def rrf_score_alpha(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, fusion.FusionSettings(alpha=0.5, weights=[2.0, 1.0, 1.0, 0.5]))


def rrf_weights_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Three weights for four streams count as all one; k below one counts as one."""
    return _fused(spark, folder, fusion.FusionSettings(k=0.2, weights=[3.0, 1.0, 1.0]))


def rrf_three_streams(spark: SparkSession, folder: str) -> DataFrame:
    streams = table(spark, folder, "streams")
    fused = fusion.fuse_three(*(streams.filter(F.col("stream") == s) for s in range(3)), fusion.FusionSettings(weights=[1.0, 1.0, 1.0]), ("query_id",))
    best = fusion.best_fused(fused, 10, ("query_id",))
    return best.select("query_id", F.col("position").cast("long").alias("position"), "id", F.round("fused", 9).alias("fused"))


def ordered_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of the postings by summed weight as one ranked list, numbered without one task for all."""
    sums = table(spark, folder, "postings").filter("weight in (1.0, 2.0, 3.0) and node_id is not null").groupBy("node_id").agg(F.sum("weight").alias("score"))
    return fusion.as_stream(sums, 0).select("pos", "id", "score")


def walk_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Where the walk of the first query starts, with a node under the cursor."""
    own = table(spark, folder, "streams").filter("query_id = 1 and id is not null").select("stream", F.col("id").alias("node_id"), "score").distinct()
    first, second = (own.filter(F.col("stream") == s).select("node_id", "score") for s in (0, 1))
    return fusion.walk_seeds(first, second, 3).select("node_id", F.round("seed", 9).alias("seed"))


def embedded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What is embedded of each searchable node."""
    return fusion.node_texts(table(spark, folder, "nodes").dropDuplicates()).select("node_id", F.md5("text").alias("digest"))


def mock_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", mock_embedding("text").alias("v"))
    return rows.select("doc_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 64), 6).alias("last"))


def fallback_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nodes whose text is nearest to the query under embeddings that need no model."""
    texts = fusion.node_texts(table(spark, folder, "nodes"))
    vectors = texts.select("node_id", fallback_embedding("text").alias("embedding"))
    return fusion.semantic_search(vectors, fusion.query_vector(spark, QUERY, fallback_embedding), 10).select("node_id", F.round("score", 6).alias("score"))


_INDEXES: dict[tuple, fusion.SearchIndex] = {}


def _index(spark: SparkSession, folder: str) -> fusion.SearchIndex:
    """The search tables of a folder, made at the first request and again when its tables have changed."""
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    states = tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for name in ("nodes", "edges") for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")))
    key = (spark.sparkContext.applicationId, folder, states)
    if key not in _INDEXES:
        _INDEXES[key] = fusion.SearchIndex.build(table(spark, folder, "nodes"), table(spark, folder, "edges"), fallback_embedding)
    return _INDEXES[key]


def search_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each search table, made if they are not there."""
    index = _index(spark, folder)
    counts = [x.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("rows")) for name, x in (("vectors", index.vectors), ("membership", index.membership), ("moves", index.moves), ("nodes", index.nodes))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Search over prepared tables: a query reads vectors, communities and moves, and runs its own walk."""
    nodes, edges, index = table(spark, folder, "nodes"), table(spark, folder, "edges"), _index(spark, folder)
    found = fusion.hybrid_search(index.nodes, edges, table(spark, folder, "postings"), index.vectors, index.membership, QUERY, fallback_embedding, 10, moves=index.moves, walked=nodes)
    return found.select("position", "node_id", "name", "kind", F.round("fused", 9).alias("fused"))


def hybrid_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """The same search with the stand-in embedding, a given membership and five rounds of the walk."""
    nodes, edges = table(spark, folder, "nodes"), table(spark, folder, "edges")
    vectors = fusion.node_texts(nodes.dropDuplicates()).select("node_id", mock_embedding("text").alias("embedding"))
    labels = nodes.select("node_id").dropna().distinct().withColumn("community", F.pmod("node_id", F.lit(PARTS)))
    found = fusion.hybrid_search(nodes, graph.clean_edges(edges, nodes, loops=True), table(spark, folder, "postings"), vectors, labels, QUERY, mock_embedding, 10, rounds=ROUNDS)
    return found.select(F.col("position").cast("long").alias("position"), "node_id", F.round("fused", 9).alias("fused"))


QUERIES = {f.__name__: f for f in (lexical_topk, query_tokens, trigram_topk, trigram_postings, trigram_source_postings, trigram_indexed, cosine_topk, rrf_four_streams, rrf_score_alpha, rrf_weights_mismatch, rrf_three_streams, ordered_stream, walk_seeds, embedded_texts, mock_embeddings, fallback_neighbours, search_index, hybrid_search, hybrid_fixed)}


def _rrf_sql(k: float, alpha: float, weights: list[float], most: int = 3) -> str:
    return f"""
        WITH rows AS (SELECT DISTINCT query_id, stream, pos, id, score FROM streams WHERE stream <= {most} AND pos IS NOT NULL AND id IS NOT NULL),
        ranges AS (SELECT query_id, stream, min(score) FILTER (isfinite(score)) AS low, max(score) FILTER (isfinite(score)) AS high FROM rows GROUP BY ALL),
        firsts AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY query_id, stream, id ORDER BY pos, score) = 1),
        parts AS (SELECT f.query_id, f.stream, f.pos, f.id, ([{", ".join(map(str, weights))}])[f.stream + 1] / ({k} + f.pos * (1 - least({alpha} *
                  CASE WHEN high > low AND isfinite(f.score) THEN (f.score - low) / (high - low) ELSE 0 END, 1))) AS part FROM firsts f JOIN ranges r USING (query_id, stream)),
        fused AS (SELECT query_id, id, coalesce(max(part) FILTER (stream = 0), 0) + coalesce(max(part) FILTER (stream = 1), 0) + coalesce(max(part) FILTER (stream = 2), 0) + coalesce(max(part) FILTER (stream = 3), 0) AS fused,
                  min(stream::BIGINT * 1000000000 + pos) AS ordinal FROM parts GROUP BY ALL),
        placed AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ordinal, id) AS position, id, round(fused, 9) AS fused FROM fused)
        SELECT * FROM placed WHERE position <= 10
    """


_TEXTS = """(SELECT DISTINCT node_id, CASE WHEN len(string_split(tracker_id, '::')) > 2 THEN '[module: ' || array_to_string(string_split(tracker_id, '::')[:-3], '::') || ']' || chr(10) ELSE '' END
        || concat_ws(' ', tracker_id, name, kind) || chr(10) || coalesce(source, '') || chr(10) || coalesce(source, '') AS t FROM nodes
        WHERE node_id IS NOT NULL AND kind IN ('fn', 'function', 'struct', 'enum', 'trait', 'impl', 'type', 'const', 'static', 'macro', 'mod', 'module'))"""

SQL = {
    "lexical_topk": f"""
        WITH hits AS (SELECT node_id, sum(weight) AS total, max(line) - min(line) AS span, count(*) AS n FROM postings
                      WHERE term IN ({", ".join(repr(t) for t in lexical.terms_of(QUERY))}) AND node_id IS NOT NULL AND line IS NOT NULL AND weight > 0 AND NOT isnan(weight) GROUP BY node_id)
        SELECT node_id, round(CASE WHEN n > 1 THEN total * exp(-span / 6.0) ELSE total END, 6) AS score FROM hits WHERE total > 0
        ORDER BY CASE WHEN n > 1 THEN total * exp(-span / 6.0) ELSE total END DESC, node_id LIMIT 20
    """,
    "query_tokens": """
        WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM eval_items)
        SELECT item_id, len(terms)::INT AS n_terms, array_to_string(terms, ' ') AS terms FROM t
    """,
    "trigram_topk": f"""
        WITH q AS (SELECT list_transform(range(1, length('{TRIGRAM_QUERY}') - 1), lambda i: substr('{TRIGRAM_QUERY}', i, 3)) AS q),
        d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''),
        g AS (SELECT doc_id, CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END AS g FROM d),
        s AS (SELECT doc_id, len(list_intersect(list_distinct(g), list_distinct(q))) AS common, len(list_distinct(g)) AS own, len(list_distinct(q)) AS asked,
              list_sum(list_transform(g, lambda x: len(list_filter(q, lambda y: y = x)))) AS score FROM g, q)
        SELECT doc_id, round(common / (own + asked - common), 6) AS jaccard, score::BIGINT AS score FROM s WHERE common > 0 ORDER BY common / (own + asked - common) DESC, score DESC, doc_id LIMIT 20
    """,
    "trigram_postings": """
        WITH n AS (SELECT DISTINCT node_id, lower(name) AS t FROM nodes WHERE node_id IS NOT NULL AND name IS NOT NULL AND name <> ''),
        g AS (SELECT node_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END) AS gram FROM n),
        c AS (SELECT gram, node_id, count(*) AS n FROM g GROUP BY ALL)
        SELECT gram, count(*) AS chunks, sum(n)::BIGINT AS occurrences FROM c GROUP BY gram
    """,
    "trigram_source_postings": """
        WITH n AS (SELECT DISTINCT node_id, source FROM nodes WHERE node_id IS NOT NULL AND source IS NOT NULL AND source <> ''),
        t AS (SELECT node_id, lower(source) AS t FROM n),
        g AS (SELECT node_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END) AS gram FROM t),
        c AS (SELECT gram, node_id, count(*) AS n FROM g GROUP BY ALL)
        SELECT gram, count(*) AS chunks, sum(n)::BIGINT AS occurrences FROM c GROUP BY gram
    """,
    "cosine_topk": """
        WITH s AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.03)
        SELECT query, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10
    """,
    "trigram_indexed": f"""
        WITH q AS (SELECT list_transform(range(1, length('{NAME_QUERY}') - 1), lambda i: substr('{NAME_QUERY}', i, 3)) AS q),
        n AS (SELECT DISTINCT node_id, lower(CASE WHEN node_id % 10 = 1 THEN name || '_budget' ELSE name END) AS t FROM nodes WHERE node_id IS NOT NULL AND name IS NOT NULL AND name <> '' AND node_id % 10 <> 2),
        g AS (SELECT node_id, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END) AS gram FROM n),
        c AS (SELECT node_id, gram, count(*) AS n FROM g GROUP BY ALL),
        s AS (SELECT node_id, count(*) FILTER (list_contains(q, gram)) AS common, count(*) AS own, any_value(len(list_distinct(q))) AS asked, sum(n * len(list_filter(q, lambda y: y = gram))) AS score FROM c, q GROUP BY node_id)
        SELECT node_id, round(common / (own + asked - common), 6) AS jaccard, score::BIGINT AS score FROM s WHERE common > 0 ORDER BY common / (own + asked - common) DESC, score DESC, node_id LIMIT 20
    """,
    "rrf_three_streams": _rrf_sql(60, 0, [1, 1, 1], 2),
    "ordered_stream": """
        SELECT (row_number() OVER (ORDER BY score DESC, id) - 1)::INT AS pos, id, score FROM (SELECT node_id AS id, sum(weight) AS score FROM postings WHERE weight IN (1.0, 2.0, 3.0) AND node_id IS NOT NULL GROUP BY node_id)
    """,
    "walk_seeds": """
        WITH own AS (SELECT DISTINCT stream, id, score FROM streams WHERE query_id = 1 AND stream IN (0, 1) AND id IS NOT NULL),
        p AS (SELECT id, row_number() OVER (PARTITION BY stream ORDER BY score DESC NULLS LAST, id) AS p FROM own)
        SELECT id AS node_id, round(sum(seed), 9) AS seed FROM (SELECT id, 1.0::DOUBLE / p AS seed FROM p WHERE p <= 8 UNION ALL SELECT 3, 4.0) GROUP BY id
    """,
    "embedded_texts": f"SELECT node_id, md5(t) AS digest FROM {_TEXTS}",
    "hybrid_fixed": f"""
        WITH RECURSIVE {walk_steps("SELECT node_id, seed / sum(seed) OVER () AS seed FROM seeds JOIN ids USING (node_id)", f"""
            texts AS (SELECT * FROM {_TEXTS}),
            chars AS (SELECT node_id, unnest(list_transform(range(0, length(t)), lambda i: {{'p': i, 'c': unicode(substr(t, i + 1, 1))}})) AS e FROM texts),
            slots AS (SELECT node_id, (e.p * 7 + e.c) % 64 AS slot, sum(e.c / 256.0) AS value FROM chars GROUP BY ALL),
            qc AS (SELECT i AS p, unicode(substr('{QUERY}', i + 1, 1)) AS c FROM range(0, length('{QUERY}')) t(i)),
            qs AS (SELECT (p * 7 + c) % 64 AS slot, sum(c / 256.0) AS value FROM qc GROUP BY ALL),
            cos AS (SELECT s.node_id, sum(s.value * coalesce(q.value, 0)) / sqrt(sum(s.value * s.value)) / (SELECT sqrt(sum(value * value)) FROM qs) AS score FROM slots s LEFT JOIN qs q USING (slot) GROUP BY s.node_id),
            found AS (SELECT node_id FROM texts),
            hits AS (SELECT node_id, sum(weight) AS total, max(line) - min(line) AS span, count(*) AS n FROM postings JOIN found USING (node_id)
                WHERE term IN ({", ".join(repr(t) for t in lexical.terms_of(QUERY))}) AND line IS NOT NULL AND weight > 0 AND NOT isnan(weight) GROUP BY node_id),
            lists AS (SELECT 0 AS stream, node_id, CASE WHEN n > 1 THEN total * exp(-span / 6.0) ELSE total END AS score FROM hits WHERE total > 0
                UNION ALL SELECT 1, node_id, score FROM cos WHERE score >= 0.03),
            placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY score DESC, node_id) - 1 AS pos FROM lists QUALIFY pos < 40),
            seeds AS (SELECT node_id, sum(1.0::DOUBLE / (pos + 1)) AS seed FROM placed WHERE pos < 8 GROUP BY node_id)""")},
        home AS (SELECT node_id % {PARTS} AS c FROM placed WHERE pos = 0 ORDER BY stream LIMIT 1),
        looped AS (SELECT DISTINCT src, dst, kind FROM edges WHERE src IN (SELECT node_id FROM ids) AND dst IN (SELECT node_id FROM ids)),
        between_ AS (SELECT least(src % {PARTS}, dst % {PARTS}) AS x, greatest(src % {PARTS}, dst % {PARTS}) AS y, sum({weights_sql(graph.COMMUNITY_WEIGHTS)})::DOUBLE AS w FROM looped WHERE src % {PARTS} <> dst % {PARTS} GROUP BY 1, 2),
        near AS (SELECT CASE WHEN x = c THEN y ELSE x END AS c, w / (SELECT max(w) FROM between_) * 0.5 AS near FROM between_, home WHERE x = c OR y = c),
        every AS (SELECT stream, pos, node_id FROM placed
            UNION ALL SELECT 2, row_number() OVER (ORDER BY score DESC, node_id) - 1 AS pos, node_id FROM r{ROUNDS} JOIN found USING (node_id) WHERE score > 0 QUALIFY pos < 40
            UNION ALL SELECT 3, row_number() OVER (ORDER BY s DESC, node_id) - 1 AS pos, node_id FROM (SELECT node_id, CASE WHEN node_id % {PARTS} = (SELECT c FROM home) THEN 1.0 ELSE round(near, 6) END AS s FROM found LEFT JOIN near ON near.c = node_id % {PARTS}) WHERE s > 0 QUALIFY pos < 40),
        fused AS (SELECT node_id, sum(1.0::DOUBLE / (60 + pos)) AS fused, min(stream * 1000000 + pos) AS ordinal FROM every GROUP BY node_id)
        SELECT row_number() OVER (ORDER BY fused DESC, ordinal, node_id) AS position, node_id, round(fused, 9) AS fused FROM fused QUALIFY position <= 10
    """,
    "rrf_four_streams": _rrf_sql(60, 0, [1, 1, 1, 1]),
    "rrf_score_alpha": _rrf_sql(60, 0.5, [2, 1, 1, 0.5]),
    "rrf_weights_mismatch": _rrf_sql(1, 0, [1, 1, 1, 1]),
    "mock_embeddings": """
        WITH c AS (SELECT doc_id, unnest(list_transform(range(0, length(text)), lambda i: {'p': i, 'c': unicode(substr(text, i + 1, 1))})) AS e FROM documents WHERE text IS NOT NULL AND text <> ''),
        v AS (SELECT doc_id, (e.p * 7 + e.c) % 64 AS slot, sum(e.c / 256.0) AS value FROM c GROUP BY ALL),
        n AS (SELECT doc_id, sqrt(sum(value * value)) AS size, coalesce(max(value) FILTER (slot = 0), 0) AS a, coalesce(max(value) FILTER (slot = 63), 0) AS b FROM v GROUP BY ALL)
        SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(round(a / size, 6), 0) END AS first, CASE WHEN text IS NULL THEN NULL ELSE coalesce(round(b / size, 6), 0) END AS last FROM documents d LEFT JOIN n USING (doc_id)
    """,
}
