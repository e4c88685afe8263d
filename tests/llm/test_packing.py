import random

from pyspark.sql import functions as F

from lodestack.llm import packing as P

DEP = "dep_id long, window_id int, module_path string, text string, tokens long, was_transformed boolean"


def tables(spark, rows, windows=((1, "small", 100), (2, "none", 0), (3, "large", 1000))):
    return spark.createDataFrame(rows, DEP), spark.createDataFrame(list(windows), "window_id int, label string, capacity long")


def estimate(text):
    size = len(text.encode())
    return max(-(-size * 5 // 16), sum(text.count(c) for c in P.STANDALONE) // 3, 1) if text else 0


def test_no_prompt_overflows_and_nothing_is_lost(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 3]), "m", "word " * rng.randint(1, 120), rng.randint(0, 9), True) for i in range(300)]
    deps, windows = tables(spark, rows + rows[:20])
    for lane_rows in (10_000, 7):
        placed = P.pack(deps, windows, lane_rows=lane_rows, most_open=4).collect()
        fill = {}
        for r in placed:
            fill[r.window_id, r.prompt] = fill.get((r.window_id, r.prompt), 0) + r.tokens
            assert r.tokens <= r.capacity
        assert all(v <= {1: 100, 3: 1000}[w] for (w, _), v in fill.items())
        assert {r.dep_id for r in placed} == set(range(300))
        texts = {i: t for i, _, _, t, _, _ in rows}
        for i, t in texts.items():
            mine = sorted((r for r in placed if r.dep_id == i), key=lambda r: r.piece)
            capacity = mine[0].capacity
            assert (len(mine) > 1) == (estimate(t) > capacity)
            if len(mine) > 1:
                assert "".join(t[r.start : r.end] for r in mine) == t and [r.piece for r in mine] == list(range(len(mine)))
        used = sum(fill.values())
        room = sum({1: 100, 3: 1000}[w] for w, _ in fill)
        assert used / room > 0.85


def test_pieces_round_trip_with_signs_and_wide_characters():
    for text in ("a" * 1000, "{}" * 700, "日本語" * 200, "𝒳{é" * 99, "x"):
        parts = P.pieces_of(text, 10)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert all(estimate(text[a:b]) == n <= 10 for a, b, n in parts)


def test_dirt_has_defined_results(spark):
    rows = [
        (1, 1, None, None, 250, None), (2, 1, None, None, None, None), (3, 1, None, "", 999, True), (4, 9, "m", "text", 1, True), (5, 2, "m", "text", 1, True),
        (None, 1, "m", "text", 1, True), (6, None, "m", "text", 1, True), (7, 1, "m", "short", 10_000, False), (8, 1, "m", None, -5, True), (9, 1, "m", "long " * 4000, None, True),
    ]
    deps, windows = tables(spark, rows)
    assert {r.dep_id for r in P.cut_texts(deps.withColumn("capacity", F.lit(1)).withColumn("lane", F.lit(1)), windows).collect()} == {1, 9}
    assert {r.dep_id for r in P.pack(deps, windows).collect()} == {1, 3, 7, 8, 9}
    assert P.pack(deps.limit(0), windows).count() == 0 and P.pack(deps, windows.limit(0)).count() == 0
    assert P.fill_report(P.pack(deps, windows)).count() == 1


def test_bounded_space_places_best_and_emits_fullest():
    prompts = P.Prompts(10, 2)
    assert [prompts.place(n) for n in (6, 7, 3, 4)] == [0, 1, 1, 0]
    assert prompts.place(9) == 2 and len(prompts.room) == 2


def test_open_prompts_of_many_lanes_are_merged(spark):
    rng = random.Random(8)
    rows = [(i, 1, "m", "word " * rng.randint(1, 30), 0, True) for i in range(4000)]
    deps, windows = tables(spark, rows)
    size = sum(estimate(r[3]) for r in rows)
    whole = P.fill_report(P.pack(deps, windows)).first()
    assert whole.tokens == size and whole.fill > 0.98
    # lanes of a few texts leave nearly empty prompts, which only the rounds of merging put together
    for lane_rows, least in ((60, 0.95), (3, 0.85)):
        report = P.fill_report(P.pack(deps, windows, lane_rows=lane_rows, most_open=4)).first()
        assert report.tokens == size and report.fill > least
    seen = P.window_report(P.pack(deps, windows)).first()
    assert seen.overfull == 0 and seen.tight and seen.tokens == size
