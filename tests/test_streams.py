from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestack.streaming import changes as C

START = datetime(2024, 1, 1)


def _events(spark, offsets, user=1):
    return spark.createDataFrame([(user, i, START + timedelta(seconds=s)) for i, s in enumerate(offsets)], "user_id long, event_id long, ts timestamp")


def _run(spark, frame, build, name, folder):
    frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_token_bucket_batch_and_stream(spark, tmp_path):
    events = _events(spark, [0, 0, 0, 0, 1, 1, 5])
    want = {0: True, 1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    assert {r.event_id: r.allowed for r in C.token_bucket(events, "user_id", 2.0, 1.0).collect()} == want
    got = _run(spark, events, lambda s: C.limited(s, "user_id", 2.0, 1.0), "limited", str(tmp_path))
    assert {r.event_id: r.allowed for r in got} == want


def test_batches_are_anchored_at_their_first_event(spark):
    events = _events(spark, [0.0, 0.3, 0.6, 0.9, 1.2])
    got = [(r.batch, r.n) for r in C.anchored_batches(events, "user_id", quiet_ms=500).orderBy("batch").collect()]
    assert got == [(0, 2), (1, 2), (2, 1)]
    assert C.anchored_batches(events.limit(0), "user_id").count() == 0


def test_newest_requests(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 1)], "file string, generation long")
    got = _run(spark, rows, lambda s: C.newest_requests(s, "file", "generation"), "newest", str(tmp_path))
    assert {(r.file, r.generation) for r in got} == {("a", 3), ("b", 1)}


def test_debounced_stream(spark, tmp_path):
    events = _events(spark, [0.0, 0.2, 0.9, 60.0]).select("user_id", "ts")
    got = _run(spark, events, lambda s: C.debounced(s, "user_id"), "debounced", str(tmp_path))
    assert sorted(r.n for r in got)[:2] == [1, 2]


def test_watched_and_snapshots(spark):
    rows = spark.createDataFrame([("src\\a.rs", "create"), ("./src/b.rs", "removed"), ("target/c.rs", "modified"), ("d.txt", "modified"), (None, "create")], "path string, kind string")
    assert {tuple(r) for r in C.watched(rows).collect()} == {("src/a.rs", "created"), ("src/b.rs", "deleted")}
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {tuple(r) for r in C.snapshot_changes(before, after).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}


def test_updates_apply_once(spark, tmp_path):
    chunks = spark.createDataFrame([("x1", "./f.rs", "h1"), ("x2", "g.rs", "h2")], "chunk_id string, file_path string, content_hash string")
    fresh = spark.createDataFrame([("x3", "f.rs", "h3")], chunks.schema)
    after, report = C.apply_update(chunks, fresh, spark.createDataFrame([("f.rs",)], "path string"))
    assert {r.chunk_id for r in after.collect()} == {"x2", "x3"}
    assert {(r.change, r.chunks) for r in report.collect()} == {("changed", 1), ("deleted", 1)}
    spark.createDataFrame([("src/a.rs", "modified", START), ("src/a.rs", "modified", START)], "path string, kind string, ts timestamp").write.json(f"{tmp_path}/changes")
    seen = []
    query = C.run_updates(C.read_changes(spark, f"{tmp_path}/changes"), f"{tmp_path}/check", lambda batch, number: seen.append((number, [r.path for r in batch.collect()])))
    query.processAllAvailable()
    query.stop()
    assert seen == [(0, ["src/a.rs"])]


def test_recency_windows(spark):
    events = _events(spark, [0, 30]).withColumnRenamed("user_id", "node_id").select("node_id", "ts")
    rows = C.window_boosts(C.recency_windows(events)).filter("boost is not null")
    assert rows.agg(F.max("boost")).first()[0] > 0
