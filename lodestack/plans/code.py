"""Queries over the Rust sources of nodes: chunks, postings, compression, bridges, cursors, packing, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import token_estimate
from ..operators import build, compress, context, graph, indexing
from ..runtime import table
from ..sources.files import listing, normal_path
from ..streaming import changes


def _code(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nodes").filter("kind <> 'file' and source is not null and node_id is not null")
    return rows.select("node_id", "tracker_id", "name", "kind", "source", "file_path").dropDuplicates(["node_id"])


def chunk_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all sources by kind, each node as one file."""
    files = _code(spark, folder).select(F.concat_ws("#", "file_path", F.col("node_id").cast("string")).alias("path"), F.col("source").alias("text"))
    return build.chunks(files).groupBy("kind").agg(F.count("*").alias("chunks"), F.countDistinct("content_hash").alias("hashes"))


def crate_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges by kind of the graph built from all sources."""
    files = _code(spark, folder).select(F.concat("name", F.lit("_"), F.col("node_id").cast("string"), F.lit(".rs")).alias("path"), F.col("source").alias("text"))
    return graph.edge_kind_stats(build.build_graph(files)[1])


def source_postings(spark: SparkSession, folder: str) -> DataFrame:
    found = build.postings(_code(spark, folder))
    return found.groupBy("weight").agg(F.count("*").alias("postings"), F.countDistinct("node_id").alias("nodes"))


def signature_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _code(spark, folder).select("node_id", token_estimate(F.col("source")).alias("before"), token_estimate(compress.to_signatures("source")).alias("after"))
    return rows


def skeleton_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _code(spark, folder).select("node_id", compress.hidden_body_count("source").alias("hidden"), F.octet_length(compress.to_skeleton("source")).alias("bytes"))


def custom_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", compress.custom_identifiers(F.col("text")).alias("names"))
    return rows.select("doc_id", F.size("names").alias("n"), F.md5(F.array_join("names", ",")).alias("digest"))


def dictionary_savings(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes before and after dictionaries, and whether hydrating gives every source back."""
    rows = _code(spark, folder)
    done = compress.dictionary_compress(rows).join(rows.select("node_id", "source"), "node_id")
    same = (compress.hydrate(F.col("compressed"), F.col("dictionary")) == F.col("source")).cast("int")
    return done.agg(F.sum("original_bytes").alias("original"), F.sum("compressed_bytes").alias("compressed"), F.sum(F.octet_length(compress.legend(F.col("dictionary")))).alias("legends"), F.min(same).alias("lossless"))


def aliased_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _code(spark, folder).select("node_id", F.octet_length("source").alias("before"), F.octet_length(compress.aliased("source")).alias("after"))


def bridge_resources(spark: SparkSession, folder: str) -> DataFrame:
    found = build.bridges(table(spark, folder, "nodes"), api=r'"(https?://[^"/\s]+/[^"]*)"')
    return found.select("node_id", "type", "target", F.explode(build.resources(F.col("type"), F.col("target"))).alias("resource")).groupBy("resource").agg(F.countDistinct("node_id").alias("nodes"))


def bridge_links(spark: SparkSession, folder: str) -> DataFrame:
    found = build.bridges(table(spark, folder, "nodes"), api=r'"(https?://[^"/\s]+/[^"]*)"')
    return build.bridge_count(found)


def _cursors(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "nodes").filter("node_id is not null and range_start <= range_end and file_path is not null")
    return nodes.select(F.col("node_id").alias("cursor_id"), "file_path", F.floor((F.col("range_start") + F.col("range_end")) / 2).alias("offset")).distinct()


def cursor_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The narrowest node at the middle of every node's range."""
    return context.node_at_cursor(table(spark, folder, "nodes"), _cursors(spark, folder))


def cursor_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", context.byte_offset(F.col("text"), F.lit(2), F.lit(7)).alias("offset"))


def surrounding_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(context.surrounding_lines(F.col("text"), F.lit(20))).alias("digest"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Per query its hits by served score with the text of their nodes."""
    hits = table(spark, folder, "search_hits").select("query_id", "node_id", F.nanvl("rrf_score", F.lit(None).cast("double")).alias("score")).dropna().groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    texts = table(spark, folder, "nodes").select("node_id", "source").dropna().groupBy("node_id").agg(F.max("source").alias("text"))
    return hits.join(texts, "node_id").withColumn("tokens", token_estimate(F.col("text")))


def budget_packed(spark: SparkSession, folder: str) -> DataFrame:
    """What each query's prompt takes: tokens and number of dependencies of the packed ones."""
    rows = _candidates(spark, folder).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "node_id", "text", "tokens"))).alias("deps"))
    packed = rows.select("query_id", context.pack(F.col("deps"), 1200, 5).alias("deps"))
    return packed.select("query_id", F.size("deps").alias("n"), F.aggregate("deps", F.lit(0).cast("long"), lambda t, d: t + d["tokens"]).alias("tokens"))


def assembled_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of each query around an empty cursor: its hits in order until the budget is passed."""
    rows = _candidates(spark, folder).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "node_id", "text", "tokens"))).alias("deps"))
    return rows.select("query_id", F.md5(context.assemble(F.lit("// here"), F.col("deps"))).alias("digest"))


def cursor_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return context.snapshot(table(spark, folder, "nodes"), _cursors(spark, folder)).select("cursor_id", "node_id", "name", F.round("pagerank", 9).alias("pagerank"))


def kept_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Which hits of each query keep their bodies."""
    rows = _candidates(spark, folder).select("query_id", F.col("node_id").alias("id"), "score", "text")
    return compress.prune_batch(rows, ("query_id",)).select("query_id", F.col("id").alias("node_id"), "pruned")


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and an edited copy: a word replaced in each seventh, a line dropped from each eleventh."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("text").alias("old")).dropna()
    edited = F.when(F.col("doc_id") % 7 == 0, F.replace(F.col("old"), F.lit("the "), F.lit("a "))).when(F.col("doc_id") % 11 == 0, F.regexp_replace("old", r"\A[^\n]*\n", "")).otherwise(F.col("old"))
    return rows.withColumn("new", edited)


def diff_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of applied diffs. Lines are given back without their ends; the final one is that of the old text."""
    rows = _versions(spark, folder)
    return rows.select("doc_id", F.md5(compress.apply_diff("old", compress.unified_diff("old", "new"))).alias("digest"))


def diff_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = compress.diff_stats(compress.unified_diff("old", "new"))
    return _versions(spark, folder).select("doc_id", stats.alias("s")).select("doc_id", "s.hunks", "s.added", "s.removed", "s.tokens", "s.bytes")


def diff_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Hunks and changed lines of every document against its edited copy."""
    stats = compress.diff_stats(compress.unified_diff("old", "new"))
    return _versions(spark, folder).select("doc_id", stats.alias("s")).select("doc_id", (F.col("s.added") + F.col("s.removed")).alias("lines"), (F.col("s.hunks") > 0).alias("differs"))


def index_update(spark: SparkSession, folder: str) -> DataFrame:
    """What an update of the chunk index reports when some files have chunks changed and others taken out."""
    rows = _code(spark, folder).select(F.col("node_id").cast("string").alias("chunk_id"), "file_path", "source", F.sha2("source", 256).alias("content_hash"), "node_id")
    rows = rows.filter("file_path is not null")
    index = indexing.ChunkIndex.build(rows.select(*indexing.CHUNK), "key")
    path = normal_path(F.col("file_path"))
    edited = F.when(F.col("node_id") % 2 == 0, F.concat("source", F.lit(" // edited"))).otherwise(F.col("source"))
    fresh = rows.filter((F.length(path) % 5 == 0) & (F.col("node_id") % 3 != 0)).withColumn("source", edited).withColumn("content_hash", F.sha2("source", 256))
    after, report = index.update(fresh.select(*indexing.CHUNK), rows.filter(F.length(path) % 5 == 0).select(F.col("file_path").alias("path")))
    grams = after.sizes.agg(F.count("*").alias("n")).first()["n"]
    return spark.createDataFrame([(k, report[k]) for k in ("changed", "deleted", "upserted", "skipped")] + [("indexed", grams)], "what string, chunks long")


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    return listing(table(spark, folder, "nodes"))


def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that a slow bucket lets through for each user."""
    found = changes.token_bucket(table(spark, folder, "events"), "user_id", 5.0, 1.0)
    return found.groupBy("user_id").agg(F.sum(F.col("allowed").cast("long")).alias("allowed"), F.count("*").alias("requests"))


def anchored_batches(spark: SparkSession, folder: str) -> DataFrame:
    found = changes.anchored_batches(table(spark, folder, "events"), "user_id", quiet_ms=3_600_000)
    return found.groupBy("user_id").agg(F.count("*").alias("batches"), F.max("n").alias("largest"))


def watched_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a watcher would report if every node's row were a change."""
    rows = table(spark, folder, "nodes").select(F.col("file_path").alias("path"), F.when(F.col("kind") == "impl", "removed").otherwise("create").alias("kind"))
    return changes.watched(rows).groupBy("kind").agg(F.countDistinct("path").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (chunk_kinds, crate_graph, source_postings, signature_sizes, skeleton_sizes, custom_identifiers, dictionary_savings, aliased_sizes, bridge_resources, bridge_links, cursor_nodes, cursor_snapshots, assembled_prompts, cursor_offsets, surrounding_lines, budget_packed, kept_bodies, diff_round_trip, diff_statistics, diff_changes, index_update, file_listing, token_bucket, anchored_batches, watched_changes)
}

_LINES = "CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, chr(10)) THEN string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) END"
_PATH = "regexp_replace(regexp_replace(regexp_replace(replace(file_path, '\\', '/'), '/{2,}', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '/$', '')"
_KEYWORDS = ", ".join(f"'{w}'" for w in sorted(compress.KEYWORDS))
_TOKENS = "CASE WHEN text = '' THEN 0 ELSE greatest(ceil(strlen(text) * 5 / 16.0), floor(length(regexp_replace(text, '[^{}()\\[\\]:;,=<>&|#@]', '', 'g')) / 3), 1) END::BIGINT"
_HITS = f"""hits AS (SELECT query_id, node_id, max(rrf_score) AS score FROM search_hits WHERE rrf_score IS NOT NULL AND NOT isnan(rrf_score) AND query_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
        texts AS (SELECT node_id, max(source) AS text FROM nodes WHERE source IS NOT NULL GROUP BY node_id),
        cand AS (SELECT query_id, node_id, score, text, {_TOKENS} AS tokens FROM hits JOIN texts USING (node_id))"""

SQL = {
    "custom_identifiers": f"""
        WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: strlen(x) > 3 AND regexp_matches(x, '^[\\p{{L}}\\p{{M}}_]') AND x NOT IN ({_KEYWORDS})) AS w FROM documents),
        d AS (SELECT doc_id, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM w)
        SELECT doc_id, len(d)::INT AS n, md5(array_to_string(d, ',')) AS digest FROM d
    """,
    "bridge_resources": """
        WITH a AS (SELECT node_id, unnest(regexp_extract_all(source, '"(https?://[^"/\\s]+/[^"]*)"', 1)) AS target FROM nodes WHERE node_id IS NOT NULL),
        s AS (SELECT node_id, unnest(list_filter(string_split(regexp_replace(target, '[?#].*$', ''), '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '\\d+') AND lower(x) NOT IN ('api', 'v1', 'v2', 'v3', 'get', 'post', 'put', 'delete', 'patch'))) AS r FROM a)
        SELECT lower(r) AS resource, count(DISTINCT node_id) AS nodes FROM s GROUP BY 1
    """,
    "cursor_nodes": """
        WITH spans AS (SELECT DISTINCT node_id, file_path, range_start, range_end FROM nodes WHERE range_start <= range_end AND node_id IS NOT NULL),
        cursors AS (SELECT DISTINCT node_id AS cursor_id, file_path, floor((range_start + range_end) / 2)::BIGINT AS o FROM nodes WHERE node_id IS NOT NULL AND range_start <= range_end AND file_path IS NOT NULL)
        SELECT cursor_id, s.node_id FROM cursors c JOIN spans s ON s.file_path = c.file_path AND o BETWEEN range_start AND range_end
        QUALIFY row_number() OVER (PARTITION BY cursor_id ORDER BY range_end - range_start, s.node_id) = 1
    """,
    "cursor_offsets": """
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, l, least(2, len(l) - 1) AS a FROM l)
        SELECT doc_id, (coalesce(list_sum(list_transform(l[1:a], lambda x: strlen(x) + 1)), 0) + strlen(substr(l[a + 1], 1, 7)))::INT AS offset FROM p UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL
    """,
    "surrounding_lines": f"""
        WITH l AS (SELECT doc_id, text, {_LINES} AS l FROM documents), p AS (SELECT *, least(20, greatest(len(l) - 1, 0)) AS a FROM l)
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE md5(array_to_string(l[greatest(a - 16, 0) + 1:least(a + 16, len(l) - 1) + 1], chr(10))) END AS digest FROM p
    """,
    "kept_bodies": f"""
        WITH {_HITS}, r AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) - 1 AS r, count(*) OVER (PARTITION BY query_id) AS n FROM cand)
        SELECT query_id, node_id, n > 1 AND NOT (1.0::DOUBLE - r::DOUBLE / n > 0.70::DOUBLE) AS pruned FROM r
    """,
    "diff_round_trip": """
        WITH v AS (SELECT doc_id, text AS old, CASE WHEN doc_id % 7 = 0 THEN replace(text, 'the ', 'a ') WHEN doc_id % 11 = 0 THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE text END AS new FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(regexp_replace(regexp_replace(new, '\\r(\\n|$)', '\\1', 'g'), '\\n$', '') || CASE WHEN ends_with(old, chr(10)) THEN chr(10) ELSE '' END) AS digest FROM v
    """,
    "budget_packed": f"""
        WITH RECURSIVE {_HITS}, o AS (SELECT query_id, text, tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS i FROM cand),
        w(query_id, i, used, taken) AS (SELECT query_id, 0, 0::BIGINT, []::VARCHAR[] FROM (SELECT DISTINCT query_id FROM o)
            UNION ALL SELECT o.query_id, o.i, CASE WHEN used + tokens <= 1200 AND len(taken) < 5 AND NOT list_contains(taken, text) THEN used + tokens ELSE used END,
            CASE WHEN used + tokens <= 1200 AND len(taken) < 5 AND NOT list_contains(taken, text) THEN list_append(taken, text) ELSE taken END FROM w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1)
        SELECT query_id, len(taken)::INT AS n, used AS tokens FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1
    """,
    "assembled_prompts": f"""
        WITH {_HITS}, o AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS i,
            3 + sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, node_id ROWS UNBOUNDED PRECEDING) AS used FROM cand),
        p AS (SELECT query_id, string_agg(chr(10) || '// dep ' || i || chr(10) || text, '' ORDER BY i) FILTER (used <= 4000) AS t FROM o GROUP BY query_id)
        SELECT query_id, md5('// here' || coalesce(t, '')) AS digest FROM p
    """,
    "diff_changes": """
        WITH v AS (SELECT doc_id, text AS old, CASE WHEN doc_id % 7 = 0 THEN replace(text, 'the ', 'a ') WHEN doc_id % 11 = 0 THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE text END AS new FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(old, '\\r(\\n|$)', '\\1', 'g'), '\\n$', ''), chr(10)) AS o, string_split(regexp_replace(regexp_replace(new, '\\r(\\n|$)', '\\1', 'g'), '\\n$', ''), chr(10)) AS n FROM v),
        c AS (SELECT doc_id, CASE WHEN len(o) <> len(n) THEN abs(len(o) - len(n)) ELSE 2 * len(list_filter(list_zip(o, n), lambda x: x[1] <> x[2])) END::INT AS lines FROM l)
        SELECT doc_id, lines, lines > 0 AS differs FROM c
    """,
    "bridge_links": """
        WITH a AS (SELECT DISTINCT node_id, unnest(regexp_extract_all(source, '"(https?://[^"/\\s]+/[^"]*)"', 1)) AS target FROM nodes WHERE node_id IS NOT NULL),
        q AS (SELECT DISTINCT node_id, trim(unnest(list_concat(regexp_extract_all(source, '(?i)(?:query!|query_as!)\\s*\\(\\s*"([^"]*)"', 1), regexp_extract_all(source, '(?i)r#?"((?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH)\\s[^"]*)"', 1)))) AS target FROM nodes WHERE node_id IS NOT NULL),
        s AS (SELECT * FROM q WHERE target <> '' AND regexp_matches(upper(target), 'SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH|FROM|WHERE')),
        k AS (SELECT node_id, 'api:' || target AS key FROM a UNION SELECT node_id, 'sql:' || target FROM s
            UNION SELECT node_id, 'resource:' || lower(unnest(list_concat(list_concat(regexp_extract_all(target, '(?i)FROM\\s*([A-Za-z0-9_]+)', 1), regexp_extract_all(target, '(?i)JOIN\\s*([A-Za-z0-9_]+)', 1)), list_concat(regexp_extract_all(target, '(?i)INTO\\s*([A-Za-z0-9_]+)', 1), regexp_extract_all(target, '(?i)UPDATE\\s*([A-Za-z0-9_]+)', 1))))) FROM s
            UNION SELECT node_id, 'resource:' || lower(unnest(list_filter(string_split(regexp_replace(target, '[?#].*$', ''), '/'), lambda x: x <> '' AND NOT regexp_full_match(x, '\\d+') AND lower(x) NOT IN ('api', 'v1', 'v2', 'v3', 'get', 'post', 'put', 'delete', 'patch')))) FROM a)
        SELECT count(*) AS edges FROM (SELECT DISTINCT x.node_id, y.node_id FROM k x JOIN k y ON x.key = y.key AND x.node_id <> y.node_id)
    """,
    "watched_changes": f"""
        WITH p AS (SELECT {_PATH} AS path, CASE WHEN kind = 'impl' THEN 'deleted' ELSE 'created' END AS kind FROM nodes)
        SELECT kind, count(DISTINCT path) AS files FROM p WHERE ends_with(path, '.rs') AND NOT list_has_any(string_split(path, '/'), ['.git', 'target', 'node_modules', '.cache', '.idea', '.vscode']) GROUP BY kind
    """,
    "cursor_snapshots": """
        WITH spans AS (SELECT DISTINCT node_id, file_path, range_start, range_end FROM nodes WHERE range_start <= range_end AND node_id IS NOT NULL),
        cursors AS (SELECT DISTINCT node_id AS cursor_id, file_path, floor((range_start + range_end) / 2)::BIGINT AS o FROM nodes WHERE node_id IS NOT NULL AND range_start <= range_end AND file_path IS NOT NULL),
        f AS (SELECT cursor_id, s.node_id FROM cursors c JOIN spans s ON s.file_path = c.file_path AND o BETWEEN range_start AND range_end
            QUALIFY row_number() OVER (PARTITION BY cursor_id ORDER BY range_end - range_start, s.node_id) = 1),
        n AS (SELECT node_id, name, CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END AS pagerank FROM nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY CASE WHEN isnan(pagerank) THEN NULL ELSE pagerank END DESC NULLS LAST, name DESC) = 1)
        SELECT cursor_id, f.node_id, name, round(pagerank, 9) AS pagerank FROM f LEFT JOIN n USING (node_id)
    """,
    "index_update": f"""
        WITH c AS (SELECT DISTINCT node_id, source, length({_PATH}) % 5 = 0 AS touched FROM nodes WHERE kind <> 'file' AND source IS NOT NULL AND node_id IS NOT NULL AND file_path IS NOT NULL),
        n AS (SELECT count(*) AS n, count(*) FILTER (touched AND node_id % 3 = 0) AS gone, count(*) FILTER (touched AND node_id % 3 <> 0 AND node_id % 2 = 0) AS new FROM c)
        SELECT unnest(['changed', 'deleted', 'upserted', 'skipped', 'indexed']) AS what, unnest([new, gone, new, n - gone - new, n - gone]) AS chunks FROM n
    """,
    "file_listing": f"SELECT {_PATH} AS file_path, count(DISTINCT node_id) AS nodes FROM nodes WHERE file_path IS NOT NULL GROUP BY 1",
    "anchored_batches": """
        WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        w(user_id, i, anchor, batch) AS (SELECT user_id, i, t, 0 FROM e WHERE i = 1
            UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t - w.anchor > 3600 THEN e.t ELSE w.anchor END, CASE WHEN e.t - w.anchor > 3600 THEN w.batch + 1 ELSE w.batch END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1),
        b AS (SELECT user_id, batch, count(*) AS n FROM w GROUP BY ALL)
        SELECT user_id, count(*) AS batches, max(n) AS largest FROM b GROUP BY user_id
    """,
    "token_bucket": """
        WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        w(user_id, i, t, tokens, allowed) AS (SELECT user_id, i, t, 4.0::DOUBLE, 1 FROM e WHERE i = 1
            UNION ALL SELECT e.user_id, e.i, e.t, least(5.0, w.tokens + (e.t - w.t)) - CASE WHEN least(5.0, w.tokens + (e.t - w.t)) >= 1 THEN 1 ELSE 0 END, CASE WHEN least(5.0, w.tokens + (e.t - w.t)) >= 1 THEN 1 ELSE 0 END
            FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
        SELECT user_id, sum(allowed)::BIGINT AS allowed, count(*) AS requests FROM w GROUP BY user_id
    """,
}
