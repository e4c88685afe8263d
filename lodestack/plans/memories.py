"""Queries of memories and recency; documents stand in for memories, events for touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory as M
from ..runtime import table

NOW = 1_775_000_000
RECALL = "token budget chunk index"
EVENTS_NOW = "2024-01-15 00:00:00"


def _memories(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").filter("doc_id is not null and text is not null")
    namespace = F.when(F.col("lang").isNotNull(), F.lower("lang"))
    return rows.select(
        F.concat(F.lit("mem_"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"), namespace.alias("namespace"),
        (F.lit(NOW) - F.pmod(F.col("doc_id") * 7919, F.lit(2_000_000))).alias("last_accessed"), F.pmod("doc_id", F.lit(9)).alias("access_count"),
        M.importance(F.lit(None).cast("double"), F.col("text"), namespace).alias("importance"),
    )


def memory_importance(spark: SparkSession, folder: str) -> DataFrame:
    return _memories(spark, folder).select("id", F.round("importance", 6).alias("importance"))


def memory_decay(spark: SparkSession, folder: str) -> DataFrame:
    return _memories(spark, folder).select("id", F.round(M.decay(F.col("importance"), F.col("last_accessed"), F.col("access_count"), NOW), 6).alias("decay"))


def memory_recall(spark: SparkSession, folder: str) -> DataFrame:
    return M.recall(_memories(spark, folder), RECALL, NOW, 20).select("id", F.round("score", 6).alias("score"))


def memory_listed(spark: SparkSession, folder: str) -> DataFrame:
    return M.listing(_memories(spark, folder), "de").select("id", "last_accessed")


def memory_pruned(spark: SparkSession, folder: str) -> DataFrame:
    return M.prune(_memories(spark, folder), NOW, 0.3).select("id")


def memory_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Memories for each namespace after one is forgotten, one moved and one read."""
    rows = _memories(spark, folder)
    rows = M.forget(rows, spark.createDataFrame([("mem_100001",)], "id string"))
    rows = M.touch(M.update(rows, "mem_100002", 0.9, "moved"), "mem_100003", NOW)
    return rows.groupBy("namespace").agg(F.count("*").alias("memories"), F.sum("access_count").alias("accesses"))


def _now():
    return F.lit(EVENTS_NOW).cast("timestamp")


def recency_boosts(spark: SparkSession, folder: str) -> DataFrame:
    found = M.boosts(table(spark, folder, "events"), _now(), "user_id")
    return found.select("node_id", F.round("boost", 6).alias("boost"))


def boosted_seeds(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    seeds = events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("node_id")).agg(F.count("*").cast("double").alias("seed"))
    return M.boosted_seeds(seeds, M.boosts(events, _now(), "user_id")).select("node_id", F.round("seed", 6).alias("seed"))


def window_summary(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.lit("user").alias("kind"), F.col("event_type").alias("action"))
    return M.summary(events, _now())


def latest_generation(spark: SparkSession, folder: str) -> DataFrame:
    return M.latest_generation(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


QUERIES = {f.__name__: f for f in (memory_importance, memory_decay, memory_recall, memory_listed, memory_pruned, memory_edited, recency_boosts, boosted_seeds, window_summary, latest_generation)}

_MEM = f"""(SELECT 'mem_' || doc_id AS id, text AS content, lower(lang) AS namespace, {NOW} - (doc_id * 7919) % 2000000 AS last_accessed, doc_id % 9 AS access_count,
            least(greatest(0.5 + least(strlen(text) / 200.0, 0.3) + CASE WHEN lang IS NOT NULL THEN 0.2 ELSE 0.0 END - CASE WHEN strlen(text) < 20 THEN 0.1 ELSE 0.0 END, 0), 1)::DOUBLE AS importance
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""
_DECAY = f"importance * pow(0.5, ({NOW} - last_accessed) / 604800.0) * (1 + ln(1 + access_count) * 0.1) * CASE WHEN {NOW} - last_accessed < 3600 THEN 2 ELSE 1 END"
_COUNT = " + ".join(f"contains(lower(content), '{w}')::INT" for w in RECALL.split())
_AGE = f"(epoch(TIMESTAMP '{EVENTS_NOW}') - epoch(ts))"
_BOOST = f"(SELECT user_id AS node_id, max(3.0 * pow(2.0, -{_AGE} / 120.0)) AS boost FROM events WHERE {_AGE} >= 0 AND {_AGE} < 600 AND user_id IS NOT NULL GROUP BY user_id)"

SQL = {
    "memory_importance": f"SELECT id, round(importance, 6) AS importance FROM {_MEM}",
    "memory_decay": f"SELECT id, round({_DECAY}, 6) AS decay FROM {_MEM}",
    "memory_recall": f"SELECT id, round(({_COUNT}) * ({_DECAY}), 6) AS score FROM {_MEM} WHERE ({_COUNT}) > 0 ORDER BY round(({_COUNT}) * ({_DECAY}), 9) DESC, id LIMIT 20",
    "memory_listed": f"SELECT id, last_accessed FROM {_MEM} WHERE namespace = 'de'",
    "memory_pruned": f"SELECT id FROM {_MEM} WHERE {_DECAY} >= 0.3",
    "memory_edited": f"SELECT CASE id WHEN 'mem_100002' THEN 'moved' ELSE namespace END AS namespace, count(*) AS memories, sum(access_count + CASE id WHEN 'mem_100003' THEN 1 ELSE 0 END)::BIGINT AS accesses FROM {_MEM} WHERE id <> 'mem_100001' GROUP BY 1",
    "recency_boosts": f"SELECT node_id, round(boost, 6) AS boost FROM {_BOOST}",
    "boosted_seeds": f"SELECT node_id, round(coalesce(seed, 0) + coalesce(boost, 0), 6) AS seed FROM (SELECT user_id AS node_id, count(*)::DOUBLE AS seed FROM events WHERE event_type = 'purchase' GROUP BY 1) FULL JOIN {_BOOST} USING (node_id)",
    "window_summary": f"""
        WITH w AS (SELECT ts, event_id, '- `u' || user_id || '` (user) [' || event_type || '] — ' || floor({_AGE})::BIGINT || 's ago, boost ' || printf('%.2f', 3.0 * pow(2.0, -{_AGE} / 120.0)) AS line FROM events
                   WHERE {_AGE} >= 0 AND {_AGE} < 600 ORDER BY ts DESC, event_id DESC LIMIT 20)
        SELECT CASE WHEN count(*) = 0 THEN 'No recent activity in the sliding window.' ELSE '## Recent activity (sliding window)' || chr(10) || string_agg(line, chr(10) ORDER BY ts DESC, event_id DESC) END AS summary FROM w
    """,
    "latest_generation": "SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
