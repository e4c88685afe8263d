"""Processing only new or changed records, by intervals of processed sequence numbers.

Every arrival of a record has a number that never moves. A ledger holds, for each lane of a table, the numbers
that are done as disjoint intervals. A run subtracts them from what is available and processes the gaps,
wherever they lie: numbers that were committed late, or that a failed run left behind, are gaps like any
other. The merged intervals are committed together with the run's output by one exclusive rename of a commit
file, so a run either counts as a whole or not at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint_folder, clash_free, fingerprint, settle

LANES = 4_096
LEDGER = "lane int, lo long, hi long"


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """lane, lo, hi: overlapping, repeated and adjacent intervals joined; empty (hi < lo) and null ones dropped."""
    rows = clash_free(intervals, "lane", "lo", "hi").filter("lo <= hi and lane is not null")
    before = Window.partitionBy("lane").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("lane").orderBy("lo", "hi")
    rows = rows.withColumn("starts", (F.coalesce(F.max("hi").over(before) + 1 < F.col("lo"), F.lit(True))).cast("int"))
    return rows.withColumn("island", F.sum("starts").over(up_to)).groupBy("lane", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def subtract_intervals(available: DataFrame, done: DataFrame) -> DataFrame:
    """The parts of ``available`` that ``done`` doesn't cover, as disjoint intervals of each lane."""
    def edges(df: DataFrame, inside: Column, covered: Column) -> DataFrame:
        merged = merge_intervals(df)
        both = F.array(F.struct(F.col("lo").alias("at"), inside.alias("inside"), covered.alias("covered")), F.struct((F.col("hi") + 1).alias("at"), (-inside).alias("inside"), (-covered).alias("covered")))
        return merged.select("lane", F.inline(both))

    points = edges(available, F.lit(1), F.lit(0)).unionByName(edges(done, F.lit(0), F.lit(1))).groupBy("lane", "at").agg(F.sum("inside").alias("inside"), F.sum("covered").alias("covered"))
    along = Window.partitionBy("lane").orderBy("at")
    state = points.select("lane", F.col("at").alias("lo"), F.sum("inside").over(along).alias("inside"), F.sum("covered").over(along).alias("covered"), (F.lead("at").over(along) - 1).alias("hi"))
    return merge_intervals(state.filter("inside > 0 and covered = 0").select("lane", "lo", "hi"))


def intervals_of(rows: DataFrame) -> DataFrame:
    """Merged intervals of the rows' lane and seq."""
    return merge_intervals(rows.select("lane", F.col("seq").alias("lo"), F.col("seq").alias("hi")).distinct())


def within(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows whose seq lies in one of the (disjoint) intervals of their lane: one sort of each lane, no range join."""
    order = Window.partitionBy("lane").orderBy("seq", "__row").rowsBetween(Window.unboundedPreceding, 0)
    marks = intervals.select("lane", F.col("lo").alias("seq"), F.col("hi").alias("__hi"), F.lit(0).alias("__row"))
    both = rows.withColumn("__row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("__until", F.last("__hi", ignorenulls=True).over(order))
    return both.filter((F.col("__row") == 1) & (F.col("seq") <= F.col("__until"))).select(*rows.columns)


def sequence(rows: DataFrame, key: Column, order: list[Column], lanes: int = LANES) -> DataFrame:
    """Adds lane (hash of the key) and seq (from 1, by ``order`` within the lane).

    For append-only rows, such as arrivals: the order must be that of arrival and end in something unique.
    Then rows that come later only add numbers at the end, and the numbers of a lane stay as they were. Rows
    that are replaced or removed later would move them; give such tables numbers when they are written. A key
    of many rows should hold something that differs between them, since a lane is sorted in one task. The
    number of lanes is part of a ledger: it is chosen once, about one for each million rows expected.
    """
    laned = rows.withColumn("lane", (fingerprint(key) % lanes).cast("int"))
    return laned.withColumn("seq", F.row_number().over(Window.partitionBy("lane").orderBy(*order)).cast("long"))


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows with a lane and seq that the ledger doesn't hold."""
    return within(rows, subtract_intervals(intervals_of(rows), done))


@dataclass
class Ledger:
    """Processed intervals and outputs of runs under one folder.

    Every attempt writes its output and the merged intervals to a folder of its own, ``runs/<n>-<attempt>``,
    and then commits run n by renaming a file that names the folder to ``commits/<n>``. A rename that would
    replace a file is refused, so of several writers of one run a single one commits. The highest commit is
    the state; what was not committed is never read.
    """

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last_run(self) -> int:
        files, commits = self._files(), self._path("commits")
        if not files.exists(commits):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(commits)]
        return max([0, *(int(n) for n in names if n.isdigit())])

    def _run_folder(self, run: int) -> str:
        stream = self._files().open(self._path(f"commits/{run}"))
        try:
            return f"{self.folder}/runs/{stream.readUTF()}"
        finally:
            stream.close()

    def intervals(self, run: int | None = None) -> DataFrame:
        """lane, lo, hi that are done after a run, the last one when None; empty before the first run."""
        run = self.last_run() if run is None else run
        return self.spark.read.schema(LEDGER).parquet(f"{self._run_folder(run)}/intervals") if run else self.spark.createDataFrame([], LEDGER)

    def output(self, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._run_folder(run)}/output")

    def commit(self, number: int, output: DataFrame, done: DataFrame) -> int:
        """Write a run's output and all intervals that are done after it, then commit it as run ``number``."""
        attempt = f"{number}-{uuid.uuid4().hex}"
        output.write.parquet(f"{self.folder}/runs/{attempt}/output")
        merge_intervals(done).write.parquet(f"{self.folder}/runs/{attempt}/intervals")
        files, ready = self._files(), self._path(f"runs/{attempt}/commit")
        stream = files.create(ready, False)
        stream.writeUTF(attempt)
        stream.close()
        files.mkdirs(self._path("commits"))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        kept = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(ready, self._path(f"commits/{number}"), kept)
        except Exception as problem:
            if files.exists(self._path(f"commits/{number}")):
                raise RuntimeError(f"run {number} in {self.folder} was committed by another writer") from problem
            raise
        return number

    def run(self, rows: DataFrame, process) -> int:
        """Process the pending ones of ``rows`` (lane, seq, ...) once and commit; the number of the run.

        What is pending is written down before it is processed, so that output and intervals come from the
        same rows even if the source grows meanwhile.
        """
        base = self.last_run()
        done = self.intervals(base)
        todo = settle(pending(rows, done))
        return self.commit(base + 1, process(todo), done.unionByName(intervals_of(todo)))


# --- the sync of chunks -------------------------------------------------------------------------------


def hash_key(column: Column) -> Column:
    return F.lower(F.trim(column))


def current_rows(store: DataFrame) -> DataFrame:
    """chunk_id, content_hash, arrived_at of each chunk's row updated last among those with a hash.

    Ties of updated_at go to the row that arrived last, then to the larger hash; rows without chunk_id or
    with a null or blank hash are left out.
    """
    rows = clash_free(store, "chunk_id", "content_hash", "updated_at", "arrived_at").withColumn("content_hash", hash_key(F.col("content_hash")))
    rows = rows.filter("chunk_id is not null and content_hash <> ''")
    latest = F.max(F.struct("updated_at", "arrived_at", "content_hash")).alias("row")
    return rows.groupBy("chunk_id").agg(latest).select("chunk_id", "row.content_hash", "row.arrived_at")


def last_tree(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """chunk_id, hash of the leaves of the last successful run; of a chunk's leaves the one seen last holds."""
    finished = runs.filter((F.lower(F.trim("status")) == "succeeded") & F.col("finished_at").isNotNull() & F.col("run_id").isNotNull())
    last = finished.groupBy().agg(F.max(F.struct("finished_at", "run_id")).alias("last")).select(F.col("last.run_id").alias("run_id"))
    own = leaves.join(F.broadcast(last), "run_id", "left_semi").filter("chunk_id is not null")
    return own.groupBy("chunk_id").agg(F.max(F.struct("seen_at", hash_key(F.col("hash")).alias("hash"))).alias("leaf")).select("chunk_id", "leaf.hash")


def arrivals(store: DataFrame, lanes: int = LANES) -> DataFrame:
    """chunk_id, content_hash, updated_at, arrived_at, current, lane, seq of every distinct arrival of a chunk with a hash.

    Numbers follow the order of arrival. ``current`` tells the row of its chunk that was updated last, with
    ties as in :func:`current_rows`. A lane takes arrivals by a hash of the whole row, so that a chunk that
    arrives very often is spread over the lanes.
    """
    columns = ("chunk_id", "content_hash", "updated_at", "arrived_at")
    rows = clash_free(store, *columns).withColumn("content_hash", hash_key(F.col("content_hash")))
    rows = rows.filter("chunk_id is not null and content_hash <> ''").distinct()
    last = rows.groupBy("chunk_id").agg(F.max(F.struct("updated_at", "arrived_at", "content_hash")).alias("last"))
    marked = rows.join(last, "chunk_id").withColumn("current", F.struct("updated_at", "arrived_at", "content_hash").eqNullSafe(F.col("last"))).drop("last")
    return sequence(marked, F.struct(*columns), [F.col(c) for c in ("arrived_at", "updated_at", "chunk_id", "content_hash")], lanes)


def changed_chunks(store: DataFrame, leaves: DataFrame, runs: DataFrame, lanes: int = LANES, folder: str | None = None) -> DataFrame:
    """chunk_id and content_hash of the chunks a sync must handle: the output of a run of a ledger.

    The tree of the last successful run tells which arrivals it had done: those whose hash it holds for their
    chunk. Their numbers are committed as the first run of a ledger in ``folder`` (a new one under the
    checkpoint folder when None); the sync is the second run. It takes the numbers that the committed
    intervals leave open and gives out those that are the current row of their chunk. Without a successful
    run nothing is done before; rows without chunk_id or hash are left out; empty tables give no rows.
    """
    spark = store.sparkSession
    ledger = Ledger(spark, folder or f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}")
    numbered = settle(arrivals(store, lanes))
    if ledger.last_run() == 0:
        done = numbered.join(last_tree(leaves, runs), "chunk_id").filter("content_hash = hash")
        ledger.commit(1, done.filter("current").select("chunk_id", "content_hash"), intervals_of(done))
    return ledger.output(ledger.run(numbered, lambda todo: todo.filter("current").select("chunk_id", "content_hash")))


class Interrupted(Exception):
    """Raised by a process that is stopped before its run commits."""


def replay(store: DataFrame, runs: DataFrame, lanes: int = LANES, folder: str | None = None) -> DataFrame:
    """run_id, rows, chunks that each run of ``runs`` would have processed, had it kept a ledger.

    Numbers are given in the order in which rows were made, and a run sees what had arrived when it started:
    rows that arrive late leave gaps for later runs. A run that did not succeed is stopped before its commit;
    what it had in hand is pending again for the next one. Runs that processed nothing have no row.
    """
    spark = store.sparkSession
    ledger = Ledger(spark, folder or f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}")
    columns = ("chunk_id", "content_hash", "updated_at", "arrived_at")
    rows = clash_free(store, *columns).dropna(subset=["chunk_id", "updated_at", "arrived_at"]).distinct()
    numbered = settle(sequence(rows, F.struct(*columns), [F.col(c) for c in ("updated_at", "arrived_at", "chunk_id", "content_hash")], lanes))
    order = runs.filter("run_id is not null and started_at is not null").select("run_id", F.lower(F.trim("status")).alias("status"), "started_at").distinct().orderBy("started_at", "run_id").collect()
    committed = []
    for run in order:
        seen = numbered.filter(F.col("arrived_at") < F.lit(run["started_at"]))
        try:
            committed.append((run["run_id"], ledger.run(seen, lambda todo: _all_or_nothing(todo, run["status"]))))
        except Interrupted:
            continue
    out = None
    for run_id, number in committed:
        part = ledger.output(number).groupBy().agg(F.lit(run_id).alias("run_id"), F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("chunks")).filter("rows > 0")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "run_id long, rows long, chunks long")


def _all_or_nothing(todo: DataFrame, status: str | None) -> DataFrame:
    if status != "succeeded":
        raise Interrupted(status)
    return todo.select("chunk_id", "content_hash")
