import random

from pyspark.sql import functions as F

from lodestack.llm import leakage as L

WORDS = [f"w{i}" for i in range(400)]


def tables(spark, items, documents):
    return spark.createDataFrame(items, "item_id long, suite string, text string"), spark.createDataFrame(documents, "doc_id long, text string, item_id string")


def brute(items, documents, n=13):
    grams = {}
    for i, _, t in items:
        w = L.words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(i, d) for d, t, _ in documents if d is not None for w in [L.words(t or "")] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ()) if i is not None}


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, "s", text(rng.choice([5, 13, 40, 90]))) for i in range(20)]
    documents = []
    for d in range(60):
        words = L.words(items[rng.randrange(20)][2])
        take = words[: rng.choice([11, 12, 13, 14, 30])]
        if rng.random() < 0.3 and len(take) > 20:
            take[len(take) // 2] = "other"
        odd = rng.choice([" ", "  \n", "*", "​ ", ", "])
        documents.append((d, text(rng.randint(0, 60)) + " " + odd.join(t.upper() for t in take) + ". " + text(10), None))
    return items, documents


def test_both_ways_match_brute_force(spark):
    items, documents = corpus(2)
    for limit in (L.BROADCAST_SEEDS, 0):
        got = {tuple(r) for r in L.leaked(*tables(spark, items, documents), broadcast_seeds=limit).collect()}
        assert got == brute(items, documents)


def test_words_ignore_what_shows_nothing():
    assert L.words("Ex​ceed **THE** str­ikes_of\n> café ﻿1st") == ["exceed", "the", "strikes", "of", "café", "1st"]
    assert L.words("") == [] and L.words("-- ** !!") == []


def test_substitutions_are_tolerated(spark):
    base = [f"t{i}" for i in range(40)]
    changed = base[:]
    changed[10] = changed[23] = "x"
    items, documents = [(1, "s", " ".join(base))], [(1, "start " + " ".join(changed), None)]
    row = L.overlaps(*tables(spark, items, documents)).first()
    assert (row.exact_words, row.loose_words, row.doc_word, row.item_words) == (16, 40, 1, 40)


def test_dirt(spark):
    passage = " ".join(f"t{i}" for i in range(13))
    items = [(1, "s", passage), (1, "s", passage), (2, None, None), (None, "s", passage), (3, "s", ""), (4, "s", "too short"), (5, "s", passage)]
    documents = [(1, passage, "c"), (1, passage, "c"), (2, None, None), (None, passage, None), (3, "", None), (4, ("z " * 60_000) + passage, None), (5, passage.rsplit(" ", 1)[0], None)]
    a, b = tables(spark, items, documents)
    for limit in (L.BROADCAST_SEEDS, 0):
        got = {tuple(r) for r in L.leaked(a, b.withColumn("seed", F.lit(1)), broadcast_seeds=limit).collect()}
        assert got == {(1, 1), (5, 1), (1, 4), (5, 4)}
        assert L.leaked(a.limit(0), b, broadcast_seeds=limit).count() == 0 and L.leaked(a, b.limit(0), broadcast_seeds=limit).count() == 0


def test_windows_do_not_cross_documents(spark):
    passage = [f"t{i}" for i in range(13)]
    items, documents = [(1, "s", " ".join(passage))], [(1, " ".join(passage[:7]), None), (2, " ".join(passage[7:]), None)]
    assert L.overlaps(*tables(spark, items, documents)).count() == 0


def test_hot_seeds_and_a_full_filter_change_nothing(spark):
    items, documents = corpus(3)
    got = {tuple(r) for r in L.leaked(*tables(spark, items, documents), broadcast_seeds=0, filter_bits=64, hot_seed=1).collect()}
    assert got == brute(items, documents)


def test_altered_passages(spark):
    base = [f"t{i}" for i in range(40)]
    changed = base[:]
    changed[18] = "x"
    items, documents = [(1, "s", " ".join(base))], [(1, "start " + " ".join(changed), None), (2, " ".join(base), None), (3, "other words", None)]
    for limit in (L.BROADCAST_SEEDS, 0):
        assert [tuple(r) for r in L.altered(*tables(spark, items, documents), broadcast_seeds=limit).collect()] == [(1, 1, 21, 40)]
