"""Memories that decay, and boosts for what was touched lately. ``now`` is always given, never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_LIFE = 7 * 86_400.0
RECENT = 3_600.0
WINDOW, MAX_BOOST, BOOST_HALF_LIFE = 600.0, 3.0, 120.0


def automatic_importance(content: Column, namespace: Column) -> Column:
    size = F.octet_length(content)
    raw = 0.5 + F.least(size / 200.0, F.lit(0.3)) + F.when(namespace.isNotNull(), 0.2).otherwise(0.0) - F.when(size < 20, 0.1).otherwise(0.0)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def importance(given: Column, content: Column, namespace: Column) -> Column:
    """The given importance within 0 and 1, or the automatic one."""
    return F.when(given.isNotNull(), F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))).otherwise(automatic_importance(content, namespace))


def decay(importance_: Column, last_accessed: Column, accesses: Column, now: int) -> Column:
    """Importance halved each week since the last access, raised by accesses, doubled within the last hour."""
    age = (F.lit(now) - last_accessed).cast("double")
    return importance_ * F.pow(F.lit(0.5), age / HALF_LIFE) * (1.0 + F.log1p(accesses.cast("double")) * 0.1) * F.when(age < RECENT, 2.0).otherwise(1.0)


def recall(memories: DataFrame, query: str, now: int, k: int = 10, namespace: str | None = None) -> DataFrame:
    """id, score: how many words of the query a memory contains, times its decay; best k, ties by id."""
    words = query.lower().split()
    low = F.lower("content")
    count = F.lit(0)
    for word in words:
        count = count + F.contains(low, F.lit(word)).cast("int")
    rows = memories if namespace is None else memories.filter(F.col("namespace") == namespace)
    score = count * decay(F.col("importance"), F.col("last_accessed"), F.col("access_count"), now)
    return rows.select("id", F.round(score, 9).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(max(k, 0))


def save(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Memories with ``new`` put in; of one id the new row stands."""
    return memories.join(new.select("id").distinct(), "id", "left_anti").select(*memories.columns).unionByName(new.select(*memories.columns))


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct(), "id", "left_anti")


def listing(memories: DataFrame, namespace: str | None = None, k: int | None = None) -> DataFrame:
    """Memories of one namespace, or all of them, newest access first, ties by id; at most k when given."""
    rows = memories if namespace is None else memories.filter(F.col("namespace") == namespace)
    rows = rows.orderBy(F.desc("last_accessed"), "id")
    return rows if k is None else rows.limit(max(k, 0))


def update(memories: DataFrame, id_: str, importance_: float | None = None, namespace: str | None = None) -> DataFrame:
    """Sets the namespace (null clears it) and, when given, the importance within 0 and 1."""
    here = F.col("id") == id_
    out = memories.withColumn("namespace", F.when(here, F.lit(namespace)).otherwise(F.col("namespace")))
    if importance_ is None:
        return out
    return out.withColumn("importance", F.when(here, F.lit(min(max(importance_, 0.0), 1.0))).otherwise(F.col("importance")))


def touch(memories: DataFrame, id_: str, now: int) -> DataFrame:
    here = F.col("id") == id_
    return memories.withColumn("access_count", F.when(here, F.col("access_count") + 1).otherwise(F.col("access_count"))).withColumn("last_accessed", F.when(here, F.lit(now)).otherwise(F.col("last_accessed")))


def prune(memories: DataFrame, now: int, threshold: float = 0.01) -> DataFrame:
    return memories.filter(decay(F.col("importance"), F.col("last_accessed"), F.col("access_count"), now) >= threshold)


def seconds_between(now: Column, then: Column) -> Column:
    """Seconds with fractions; times without a zone are those of the session's."""
    return now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")


def boost_of_age(age: Column) -> Column:
    return F.when((age >= 0) & (age < WINDOW), MAX_BOOST * F.pow(F.lit(2.0), -age / BOOST_HALF_LIFE))


def boosts(events: DataFrame, now: Column, id_column: str = "node_id", time_column: str = "ts") -> DataFrame:
    """node_id, boost: of each node touched in the window the boost of its latest touch."""
    age = seconds_between(now, F.col(time_column))
    rows = events.select(F.col(id_column).alias("node_id"), boost_of_age(age).alias("boost")).filter("boost is not null and node_id is not null")
    return rows.groupBy("node_id").agg(F.max("boost").alias("boost"))


def boosted_seeds(seeds: DataFrame, boost: DataFrame) -> DataFrame:
    return seeds.select("node_id", "seed").join(boost, "node_id", "full_outer").select("node_id", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("seed"))


def within_window(events: DataFrame, now: Column, time_column: str = "ts") -> DataFrame:
    age = seconds_between(now, F.col(time_column))
    return events.filter((age >= 0) & (age < WINDOW))


def summary(events: DataFrame, now: Column, k: int = 20) -> DataFrame:
    """One row: a list of the latest k events in the window, newest first."""
    age = seconds_between(now, F.col("ts"))
    last = within_window(events, now).orderBy(F.desc("ts"), F.desc("event_id")).limit(k)
    line = F.concat(F.lit("- `"), F.col("name"), F.lit("` ("), F.col("kind"), F.lit(") ["), F.col("action"), F.lit("] — "), F.floor(age).cast("string"), F.lit("s ago, boost "), F.format_string("%.2f", boost_of_age(age)))
    rows = last.select(F.struct(F.col("ts"), F.col("event_id"), line.alias("line")).alias("row")).agg(F.reverse(F.sort_array(F.collect_list("row"))).alias("rows"))
    text = F.concat(F.lit("## Recent activity (sliding window)\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return rows.select(F.when(F.size("rows") == 0, F.lit("No recent activity in the sliding window.")).otherwise(text).alias("summary"))


def latest_generation(requests: DataFrame, file_column: str, generation_column: str) -> DataFrame:
    """Of each file's requests the one of the highest generation: what is left after debouncing."""
    best = Window.partitionBy(file_column).orderBy(F.desc(generation_column))
    return requests.filter(F.col(file_column).isNotNull()).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")
