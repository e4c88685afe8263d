"""Streams: file changes, debounced batches, incremental updates, rate limits, late requests, recency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.indexing import ChunkIndex
from ..operators.lexical import replace_chunks
from ..operators.memory import WINDOW, boost_of_age, seconds_between
from ..operators.merkle import tree_diff
from ..runtime import release, settle, shuffle_width
from ..sources.files import SKIPPED, normal_path

BURST, REFILL = 60.0, 10.0
QUIET_MS = 500


# --- W1: file changes ---------------------------------------------------------------------------------


def watched(changes: DataFrame) -> DataFrame:
    """path and kind (created, modified, deleted) of Rust files outside of skipped folders, paths in one style."""
    path = normal_path(F.col("path"))
    kind = F.when(F.col("kind").isin("created", "create", "added"), "created").when(F.col("kind").isin("deleted", "removed", "remove"), "deleted").otherwise("modified")
    rows = changes.withColumn("path", path).withColumn("kind", kind)
    return rows.filter(F.col("path").endswith(".rs") & ~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(s) for s in SKIPPED))))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two listings (path, hash): what a file source, which sees only new files, can't tell."""
    a = before.groupBy("path").agg(F.max("hash").alias("old"))
    b = after.groupBy("path").agg(F.max("hash").alias("new"))
    kind = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).filter("kind is not null")


def read_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change records (path, kind, ts) written as JSON lines to a folder."""
    return watched(spark.readStream.schema("path string, kind string, ts timestamp").json(folder))


# --- W2: debounce -------------------------------------------------------------------------------------


def _cut_batches(times: list[float], quiet: float) -> list[int]:
    """Number of the batch of each of the sorted times; a batch holds what comes within ``quiet`` of its first."""
    out, number, anchor = [], -1, None
    for t in times:
        if anchor is None or t - anchor > quiet:
            number, anchor = number + 1, t
        out.append(number)
    return out


def anchored_batches(events: DataFrame, key: str, time: str = "ts", quiet_ms: int = QUIET_MS) -> DataFrame:
    """key, batch, first, last, n: batches anchored at their first event, which later events don't extend."""
    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__t")
        group["batch"] = _cut_batches(group["__t"].tolist(), quiet_ms / 1000)
        out = group.groupby("batch").agg(first=("__t", "min"), last=("__t", "max"), n=("__t", "size")).reset_index()
        out.insert(0, key, group[key].iat[0])
        return out

    rows = events.select(key, F.col(time).cast("timestamp").cast("double").alias("__t")).dropna()
    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(cut, f"{key} {kind}, batch long, first double, last double, n long")


def debounced(events: DataFrame, key: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The same over a stream of key and ts: a batch is given out once its time has passed the anchor."""
    kind = dict(events.dtypes)[key]
    state_schema = "anchor long, last long, n long"

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        anchor, last, n = state.get if state.exists else (0, 0, 0)
        if not state.hasTimedOut:
            for t in sorted(int(x.value // 1_000_000) for frame in frames for x in frame["ts"]):
                if n and t - anchor > quiet_ms:
                    out.append((keys[0], anchor, last, n))
                    n = 0
                if not n:
                    anchor = t
                last, n = max(t, last if n else t), n + 1
            state.update((anchor, last, n))
            state.setTimeoutTimestamp(max(anchor + quiet_ms + 1, state.getCurrentWatermarkMs() + 1))
        elif n:
            out.append((keys[0], anchor, last, n))
            state.remove()
        yield pd.DataFrame(out, columns=[key, "first_ms", "last_ms", "n"])

    rows = events.select(key, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{quiet_ms} milliseconds")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_ms long, last_ms long, n long", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


# --- W3: incremental update ---------------------------------------------------------------------------


def apply_update(chunks: DataFrame, fresh: DataFrame, changed_paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks after the update, report): chunks of changed files go, the newly cut ones come.

    The report counts chunks that are new or different, gone, and kept, by comparing hashes.
    """
    paths = changed_paths.select(normal_path(F.col("path")).alias("file_path")).distinct()
    kept = chunks.withColumn("file_path", normal_path(F.col("file_path"))).join(paths, "file_path", "left_anti").select(*chunks.columns)
    after = kept.unionByName(fresh.select(*chunks.columns))
    change = tree_diff(chunks.select("chunk_id", F.col("content_hash").alias("hash")), after.select("chunk_id", F.col("content_hash").alias("hash")))
    return after, change.groupBy("change").agg(F.count("*").alias("chunks"))


def update_index(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The trigram index after an update."""
    return replace_chunks(index, fresh, id_column="chunk_id", text_column="source")


class IndexKeeper:
    """Keeps a :class:`ChunkIndex` up to date: each batch of (path, kind) reads its files again and updates all parts at once.

    ``read`` gives path and text of those files that are still there; ``cut`` makes chunks of them. A batch
    whose number was applied before is left out, so that a batch that is given twice counts once.
    """

    def __init__(self, index: ChunkIndex, read: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> None:
        self.index, self.read, self.cut, self.last, self.reports = index, read, cut, -1, []

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        paths = settle(batch.select("path").distinct())
        before = self.index
        self.index, report = before.update(self.cut(self.read(paths)), paths)
        self.reports.append(report)
        self.last = number
        before.release()
        release(paths)


def run_updates(changes: DataFrame, folder: str, apply: Callable[[DataFrame, int], None]):
    """Start the stream: each micro-batch of distinct (path, kind) is applied once, by its number."""
    return changes.writeStream.option("checkpointLocation", folder).foreachBatch(lambda batch, number: apply(batch.select("path", "kind").distinct(), number)).start()


# --- W4: rate limit -----------------------------------------------------------------------------------


def _allow(times: list[float], tokens: float, last: float | None, burst: float, refill: float) -> tuple[list[bool], float, float | None]:
    burst, refill = max(burst, 1.0), max(refill, 1.0)
    out = []
    for t in times:
        if last is not None:
            tokens = min(burst, tokens + max(t - last, 0.0) * refill)
        last = t if last is None else max(last, t)
        allowed = tokens >= 1.0
        tokens -= allowed
        out.append(allowed)
    return out, tokens, last


def take(now: float, tokens: float, last: float | None, burst: float = BURST, refill: float = REFILL) -> tuple[bool, float, float | None]:
    """(allowed, tokens, last) of one request against a bucket that is kept by the caller."""
    allowed, tokens, last = _allow([now], tokens, last, burst, refill)
    return allowed[0], tokens, last


def token_bucket(events: DataFrame, key: str, burst: float = BURST, refill: float = REFILL, time: str = "ts", order: str = "event_id") -> DataFrame:
    """key, order, allowed of each event of a table, in order of time."""
    full = max(burst, 1.0)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, full, None
        for batch in batches:
            allowed: list[bool] = []
            for own, rows in batch.groupby(key, sort=False):
                if own != now:
                    now, tokens, last = own, full, None
                out, tokens, last = _allow(rows["__t"].tolist(), tokens, last, burst, refill)
                allowed += out
            batch["allowed"] = allowed
            yield batch[[key, order, "allowed"]]

    rows = events.select(key, order, F.col(time).cast("timestamp").cast("double").alias("__t")).dropna()
    kinds = dict(rows.dtypes)
    sorted_ = rows.repartition(shuffle_width(events.sparkSession), key).sortWithinPartitions(key, "__t", order)
    return sorted_.mapInPandas(decide, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean")


def limited(events: DataFrame, key: str, burst: float = BURST, refill: float = REFILL, order: str = "event_id") -> DataFrame:
    """The same over a stream; the bucket is the state of the key and is dropped once it is full again."""
    kinds = dict(events.dtypes)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (max(burst, 1.0), None)
        rows = pd.concat(list(frames)).sort_values(["__t", order])
        rows["allowed"], tokens, last = _allow(rows["__t"].tolist(), tokens, last, burst, refill)
        state.update((float(tokens), float(last)))
        state.setTimeoutDuration(int(1000 * (max(burst, 1.0) / max(refill, 1.0) + 60)))
        yield pd.DataFrame({key: rows[key], order: rows[order], "allowed": rows["allowed"]})

    rows = events.select(key, order, F.col("ts").cast("timestamp").cast("double").alias("__t")).dropna()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


# --- W5: newest request of a file ---------------------------------------------------------------------


def newest_requests(requests: DataFrame, file: str, generation: str) -> DataFrame:
    """Over a stream: each request that is newer than all before it of its file; older ones that come late are dropped."""
    kinds = dict(requests.dtypes)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else None
        newest = max(int(frame[generation].max()) for frame in frames)
        if seen is None or newest > seen:
            state.update((newest,))
            yield pd.DataFrame({file: [keys[0]], generation: [newest]})

    return requests.select(file, generation).groupBy(file).applyInPandasWithState(step, f"{file} {kinds[file]}, {generation} {kinds[generation]}", "seen long", "append", GroupStateTimeout.NoTimeout)


# --- recency as a stream, and the periodic prune ------------------------------------------------------


def recency_windows(events: DataFrame, key: str = "node_id") -> DataFrame:
    """Touches of each node in sliding windows of ten minutes; events later than that are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{int(WINDOW)} seconds")
    return rows.groupBy(F.window("ts", f"{int(WINDOW)} seconds", "120 seconds"), key).agg(F.max("ts").alias("last"), F.count("*").alias("touches"))


def window_boosts(windows: DataFrame, key: str = "node_id") -> DataFrame:
    """The boost of each node at the end of each window."""
    return windows.select(F.col("window.end").alias("at"), key, boost_of_age(seconds_between(F.col("window.end"), F.col("last"))).alias("boost"))


def prune_every(memories: DataFrame, seconds: int, folder: str, prune: Callable[[DataFrame, int], None]):
    """A timer: ``prune`` runs on each trigger of a rate stream."""
    ticks = memories.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.option("checkpointLocation", folder).trigger(processingTime=f"{seconds} seconds").foreachBatch(lambda _, number: prune(memories, number)).start()


__all__ = ["IndexKeeper", "anchored_batches", "apply_update", "debounced", "limited", "newest_requests", "prune_every", "read_changes", "recency_windows", "run_updates", "snapshot_changes", "token_bucket", "update_index", "watched", "window_boosts"]
