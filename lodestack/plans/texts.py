"""Queries of text transforms over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import STANDALONE, token_estimate
from ..runtime import table
from ..sources.files import file_set


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "source", "path")


def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def whitespace_evacuated(spark: SparkSession, folder: str) -> DataFrame:
    out = T.evacuate_whitespace(F.col("text"))
    return _documents(spark, folder).select("doc_id", F.octet_length("text").alias("before"), F.octet_length(out).alias("after"), F.md5(out).alias("digest"))


def indent_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(T.collapse_indent(F.col("text"))).alias("digest"))


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.size(T.lines(F.col("text"))).alias("n_lines"))


def ansi_stripped(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(T.strip_ansi(F.col("text"))).alias("digest"))


def lines_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(T.unlines(T.dedup_lines(T.lines(F.col("text"))))).alias("digest"))


def test_lines_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.size(T.filter_test_lines(T.lines(F.col("text")))).alias("kept"))


def smart_truncated(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(T.unlines(T.smart_truncate(T.lines(F.col("text"))))).alias("digest"))


def log_compressed(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of all documents before and after the whole pipeline for logs, as of a test run."""
    out = T.compress_output(F.col("text"), F.lit("cargo test"))
    return _documents(spark, folder).select("doc_id", F.octet_length("text").alias("before"), F.octet_length(out).alias("after"))


def symbols_folded(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes before and after folding, and whether unfolding gives the text back."""
    rows = _documents(spark, folder).select("doc_id", "text", T.fold(F.col("text"), "rust").alias("folded"))
    return rows.select("doc_id", F.octet_length("text").alias("before"), F.octet_length("folded.text").alias("after"), F.octet_length(T.fold_legend(F.col("folded"))).alias("legend"), (T.unfold(F.col("folded")) == F.col("text")).alias("same"))


def _folded(language: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = _documents(spark, folder).select("doc_id", "text", T.fold(F.col("text"), language).alias("folded"))
        return rows.select("doc_id", F.md5("folded.text").alias("digest"), (T.unfold(F.col("folded")) == F.col("text")).alias("same"))

    query.__name__ = f"symbols_folded_{language}"
    return query


def command_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a text names a test runner, and the first word in it that would wait for a terminal."""
    return _documents(spark, folder).select("doc_id", T.is_test_runner(F.col("text")).alias("tests"), T.interactive_word(F.col("text")).alias("waits"))


def file_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Of every path the text that came last."""
    rows = table(spark, folder, "documents").select("path", "text", "ingested_at")
    return file_set(rows, "ingested_at").select("path", F.md5("text").alias("digest"), "ext")


def path_languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nodes").groupBy(T.language_of(F.col("file_path")).alias("language")).agg(F.count("*").alias("nodes"))


QUERIES = {
    f.__name__: f
    for f in (token_estimates, whitespace_evacuated, indent_collapsed, line_counts, ansi_stripped, lines_deduplicated, test_lines_filtered, smart_truncated, log_compressed, symbols_folded, *(_folded(x) for x in ("python", "sql", "typescript")), command_kinds, file_versions, path_languages)
}


def _str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BLANK = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_LINES = "CASE WHEN text = '' THEN []::VARCHAR[] WHEN ends_with(text, chr(10)) THEN string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) END"
_UN = "CASE WHEN len({0}) = 0 THEN '' ELSE array_to_string({0}, chr(10)) || chr(10) END"
_SIGNS = "[^" + STANDALONE.replace("[", "\\[").replace("]", "\\]") + "]"


def _fold_sql(language: str) -> str:
    out = "SELECT doc_id, text, text AS t, 0 AS n, 0 AS l FROM documents"
    for phrase in T.fold_phrases(language):
        has = f"contains(t, {_str(phrase)}) AND NOT regexp_matches(text, '[{T.GLYPHS}]')"
        sign = f"substr('{T.GLYPHS}', n + 1, 1)"
        out = f"SELECT doc_id, text, CASE WHEN {has} THEN replace(t, {_str(phrase)}, {sign}) ELSE t END AS t, n + CASE WHEN {has} THEN 1 ELSE 0 END AS n, l + CASE WHEN {has} THEN strlen({sign}) + 2 + {len(phrase)} ELSE 0 END AS l FROM ({out})"
    return out


_ANY_FAIL = " OR ".join(f"contains(x, {_str(w)})" for w in T.FAILURE_WORDS)
_BARE = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_ANY_TEST = " OR ".join(f"contains({_BARE}, {_str(w)})" for w in T.TEST_MARKERS)

SQL = {
    "token_estimates": f"SELECT doc_id, CASE WHEN text = '' THEN 0 WHEN text IS NULL THEN NULL ELSE greatest(ceil(strlen(text) * 5 / 16.0), floor(length(regexp_replace(text, '{_SIGNS}', '', 'g')) / 3), 1) END::BIGINT AS tokens FROM documents",
    "whitespace_evacuated": f"""
        WITH t AS (SELECT doc_id, text, array_to_string(list_transform({_LINES}, lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), chr(10)) AS o FROM documents),
        c AS (SELECT doc_id, text, regexp_replace(regexp_replace(o, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n{{2,}}|\\n{{2,}}$', chr(10), 'g') AS o FROM t),
        o AS (SELECT doc_id, text, CASE WHEN regexp_full_match(o, '\\n*') THEN '' ELSE o END AS o FROM c)
        SELECT doc_id, strlen(text)::INT AS before, strlen(o)::INT AS after, md5(o) AS digest FROM o
    """,
    "indent_collapsed": "SELECT doc_id, md5(regexp_replace(text, '(?m)^[ \\t]+', ' ', 'g')) AS digest FROM documents",
    "line_counts": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len({_LINES}) END::INT AS n_lines FROM documents",
    "ansi_stripped": "SELECT doc_id, md5(replace(regexp_replace(text, '\\x1b\\[[0-9;]*[a-zA-Z]|\\x1b\\][^\\x07]*\\x07|\\x1b[()][AB0]', '', 'g'), chr(13), '')) AS digest FROM documents",
    "lines_deduplicated": f"""
        WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
        m AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY i) <> line, true) AS starts FROM e),
        g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
        c AS (SELECT doc_id, run, min(line) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS line FROM g GROUP BY ALL),
        t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY run) || chr(10) AS t FROM c GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(t, '')) END AS digest FROM documents d LEFT JOIN t USING (doc_id)
    """,
    "test_lines_filtered": f"""
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '\\[[=>.\\s]*\\]') AND ({_ANY_TEST} OR regexp_matches(x, '[A-Za-z0-9_./-]+:\\d+') OR starts_with(x, ' ') OR starts_with(x, chr(9))))) END::INT AS kept FROM documents
    """,
    "smart_truncated": f"""
        WITH l AS (SELECT doc_id, text, {_LINES} AS l FROM documents),
        t AS (SELECT doc_id, text, CASE WHEN len(l) <= {T.TRUNCATE_ABOVE} OR len(list_filter(l, lambda x: {_ANY_FAIL})) > 0 THEN l
              ELSE list_concat(list_concat(l[1:{T.TRUNCATE_KEEP}], ['[... Truncated ' || (len(l) - {2 * T.TRUNCATE_KEEP}) || ' lines of token noise ...]']), l[len(l) - {T.TRUNCATE_KEEP - 1}:]) END AS l FROM l)
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE md5({_UN.format("l")}) END AS digest FROM t
    """,
    "log_compressed": f"""
        WITH p AS (SELECT doc_id, text AS raw, replace(regexp_replace(text, '\\x1b\\[[0-9;]*[a-zA-Z]|\\x1b\\][^\\x07]*\\x07|\\x1b[()][AB0]', '', 'g'), chr(13), '') AS text FROM documents),
        l AS (SELECT doc_id, raw, list_filter({_LINES}, lambda x: NOT regexp_matches(x, '\\[[=>.\\s]*\\]') AND ({_ANY_TEST} OR regexp_matches(x, '[A-Za-z0-9_./-]+:\\d+') OR starts_with(x, ' ') OR starts_with(x, chr(9)))) AS l FROM p WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
        m AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY i) <> line, true) AS starts FROM e),
        g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
        c AS (SELECT doc_id, run, min(line) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS line FROM g GROUP BY ALL),
        d AS (SELECT doc_id, list(line ORDER BY run) AS l FROM c GROUP BY doc_id),
        t AS (SELECT doc_id, CASE WHEN len(l) <= {T.TRUNCATE_ABOVE} OR len(list_filter(l, lambda x: {_ANY_FAIL})) > 0 THEN l
              ELSE list_concat(list_concat(l[1:{T.TRUNCATE_KEEP}], ['[... Truncated ' || (len(l) - {2 * T.TRUNCATE_KEEP}) || ' lines of token noise ...]']), l[len(l) - {T.TRUNCATE_KEEP - 1}:]) END AS l FROM d)
        SELECT x.doc_id, strlen(x.text)::INT AS before, CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(strlen(array_to_string(l, chr(10)) || chr(10)), 0) END::INT AS after FROM documents x LEFT JOIN t USING (doc_id)
    """,
    "symbols_folded": f"""
        SELECT doc_id, strlen(text)::INT AS before, strlen(t)::INT AS after, CASE WHEN text IS NULL THEN NULL WHEN n = 0 THEN 0 ELSE l + {len("// token-fold decoder: ")} END::INT AS legend, CASE WHEN text IS NULL THEN NULL ELSE true END AS same FROM ({_fold_sql("rust")})
    """,
    **{f"symbols_folded_{x}": f"SELECT doc_id, md5(t) AS digest, CASE WHEN text IS NULL THEN NULL ELSE true END AS same FROM ({_fold_sql(x)})" for x in ("python", "sql", "typescript")},
    "command_kinds": f"SELECT doc_id, {' OR '.join(f'contains(text, {_str(w)})' for w in T.TEST_RUNNERS)} AS tests, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_./-]+'), lambda w: w IN ({', '.join(map(_str, T.INTERACTIVE))}))[1] AS waits FROM documents",
    "file_versions": """
        SELECT path, md5(text) AS digest, regexp_extract(path, '\\.(\\w+)$', 1) AS ext FROM documents WHERE path IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC NULLS LAST, encode(text) DESC NULLS LAST) = 1
    """,
    "path_languages": """
        WITH e AS (SELECT lower(regexp_extract(file_path, '\\.([A-Za-z]+)$', 1)) AS e FROM nodes)
        SELECT CASE WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'jsx', 'mjs') THEN 'javascript' WHEN e = 'py' THEN 'python' WHEN e = 'sql' THEN 'sql' ELSE 'rust' END AS language, count(*) AS nodes FROM e GROUP BY 1
    """,
}
