import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.operators import incremental as I

LANES = "lane int, lo long, hi long"


def spans(df):
    return sorted(tuple(r) for r in df.select("lane", "lo", "hi").collect())


def test_merge_joins_overlapping_adjacent_and_repeated(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 2, 2), (1, 1, 3), (1, 9, 9), (2, 5, 4), (None, 1, 2), (2, None, 3)], LANES)
    assert spans(I.merge_intervals(df)) == [(1, 1, 6), (1, 9, 9)]
    assert spans(I.merge_intervals(spark.createDataFrame([], LANES))) == []


def test_subtract_and_within_match_sets(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        make = lambda: [(lane, lo, lo + rng.randint(-1, 6)) for lane in (0, 1) for lo in rng.sample(range(40), 6)]
        have, done = make(), make()
        cover = lambda rows: {(x, s) for x, lo, hi in rows for s in range(lo, hi + 1)}
        left = I.subtract_intervals(spark.createDataFrame(have, LANES), spark.createDataFrame(done, LANES))
        assert cover(spans(left)) == cover(have) - cover(done)
        rows = spark.createDataFrame([(x, s) for x in (0, 1) for s in range(50)], "lane int, seq long")
        assert {tuple(r) for r in I.within(rows, left).collect()} == cover(have) - cover(done)


def test_runs_survive_failures_and_late_commits(spark, tmp_path):
    ledger = I.Ledger(spark, str(tmp_path))
    rows = lambda ids: spark.createDataFrame([(0, i, f"r{i}") for i in ids], "lane int, seq long, name string")
    assert ledger.run(rows([1, 2, 5]), lambda df: df) == 1
    assert sorted(r.seq for r in ledger.output(1).collect()) == [1, 2, 5]

    def broken(df):
        return df.withColumn("x", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        ledger.run(rows([1, 2, 5, 6]), broken)
    assert ledger.last_run() == 1
    # 3 and 4 were committed late, 6 was left behind by the failed run
    assert ledger.run(rows([1, 2, 3, 4, 5, 6]), lambda df: df) == 2
    assert sorted(r.seq for r in ledger.output(2).collect()) == [3, 4, 6]
    assert spans(ledger.intervals()) == [(0, 1, 6)]
    assert ledger.run(rows([1, 2, 3, 4, 5, 6]), lambda df: df) == 3
    assert ledger.output(3).count() == 0


def _tables(spark, store, leaves, runs):
    return (
        spark.createDataFrame(store, "chunk_id string, content_hash string, updated_at timestamp, arrived_at timestamp, hash string"),
        spark.createDataFrame(leaves, "run_id long, chunk_id string, hash string, seen_at timestamp"),
        spark.createDataFrame(runs, "run_id long, status string, started_at timestamp, finished_at timestamp"),
    )


def test_changed_chunks_cases(spark):
    from datetime import datetime as D

    t = lambda d: D(2026, 1, d)
    store = [
        ("same", " AB ", t(1), t(1), "x"), ("same", " AB ", t(1), t(1), "x"),
        ("new", "c1", t(1), t(1), None),
        ("late", "old", t(1), t(9), None), ("late", "cur", t(5), t(2), None),
        ("nohash", None, t(3), t(3), None), (None, "zz", t(3), t(3), None), ("blank", "  ", t(3), t(3), None),
    ]
    leaves = [(2, "same", "ab", t(2)), (2, "late", "cur", t(1)), (2, "late", "old", t(3)), (3, "new", "c1", t(4)), (2, "gone", "q", t(1)), (None, "new", "c1", t(1))]
    runs = [(1, "succeeded", t(1), t(2)), (2, " Succeeded", t(1), t(5)), (3, "failed", t(6), t(7)), (4, "running", t(8), None), (5, "succeeded", t(8), None)]
    found = {r.chunk_id for r in I.changed_chunks(*_tables(spark, store, leaves, runs)).collect()}
    assert found == {"new", "late"}
    # without a successful run everything is to be done; without chunks nothing
    assert {r.chunk_id for r in I.changed_chunks(*_tables(spark, store, leaves, [])).collect()} == {"same", "new", "late"}
    assert I.changed_chunks(*_tables(spark, [], leaves, runs)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=12))
def test_merge_is_idempotent_and_disjoint(spark, rows):
    once = I.merge_intervals(spark.createDataFrame(rows, LANES))
    found = spans(once)
    assert spans(I.merge_intervals(once)) == found
    for (a, _, hi), (b, lo, _) in zip(found, found[1:]):
        assert a != b or lo > hi + 1


def test_an_update_is_pending_after_its_chunk_was_done(spark, tmp_path):
    from datetime import datetime as D

    t = lambda d: D(2026, 1, d)
    ledger = I.Ledger(spark, str(tmp_path))
    rows = [("a", "h1", t(1), t(1), None), ("b", "h1", t(1), t(2), None), ("c", "h1", t(1), t(3), None)]
    take = lambda store: ledger.output(ledger.run(I.arrivals(_tables(spark, store, [], [])[0], 2), lambda todo: todo.filter("current")))
    assert {r.chunk_id for r in take(rows).collect()} == {"a", "b", "c"}
    assert {(r.chunk_id, r.content_hash) for r in take([*rows, ("a", "h2", t(5), t(5), None)]).collect()} == {("a", "h2")}
    assert take([*rows, ("a", "h2", t(5), t(5), None)]).count() == 0


def test_one_of_two_writers_commits(spark, tmp_path):
    ledger = I.Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([(0, i) for i in range(5)], "lane int, seq long")
    none = spark.createDataFrame([], LANES)

    def slow(todo):
        ledger.commit(1, rows.limit(1), I.intervals_of(rows.limit(1)))  # another writer is faster
        return todo

    with pytest.raises(RuntimeError, match="another writer"):
        ledger.run(rows, slow)
    assert ledger.last_run() == 1 and ledger.output(1).count() == 1
    ledger.run(rows, lambda todo: todo)
    assert spans(ledger.intervals()) == [(0, 0, 4)] and ledger.output(2).count() == 4 and none.count() == 0


def test_replay_takes_every_row_once(spark):
    from datetime import datetime as D

    t = lambda d: D(2026, 1, d)
    store = [("a", "x", t(1), t(1), None), ("b", "x", t(1), t(9), None), ("c", "x", t(2), t(2), None), ("c", "x", t(2), t(2), None), ("d", None, t(3), t(4), None), (None, "x", t(1), t(1), None), ("e", "x", t(20), t(20), None)]
    runs = [(1, "succeeded", t(3), t(3)), (2, "failed", t(5), t(5)), (3, " Succeeded ", t(6), t(6)), (4, "running", t(8), None), (5, "succeeded", t(12), t(13)), (None, "succeeded", t(1), t(1))]
    assert sorted(tuple(r) for r in I.replay(*_tables(spark, store, [], runs)[::2], lanes=3).collect()) == [(1, 2, 2), (3, 1, 1), (5, 1, 1)]
    assert I.replay(*_tables(spark, store, [], [])[::2]).count() == 0
