import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import mixing as M

DOC = "doc_id long, text string, source string, copies string"
GOAL = "source string, target_share double, max_repeats int"
KINDS = {"code": "fn main ( ) { let x = y ; }", "prose": "the quick story of a brown fox and its den", "log": "ERROR 2024 warn INFO line trace 0x11"}


def documents(spark, counts, unknown=0):
    rows, n = [], 0
    for source, many in counts.items():
        for i in range(many):
            rows.append((n, f"{KINDS[source]} {i} " * (3 + i % 4), f" {source.upper()} " if i % 2 else source, None))
            n += 1
    for i in range(unknown):
        rows.append((n, f"{KINDS['log']} {i} " * 4, None if i % 2 else "  ", None))
        n += 1
    return rows


def test_shares_are_met_where_they_can_be(spark):
    rows = documents(spark, {"code": 60, "prose": 60, "log": 30}, unknown=20)
    goals = spark.createDataFrame([("code", 0.5, 3), (" Prose", 0.3, 2), ("log", 0.2, 2)], GOAL)
    copies, report = M.mix(spark.createDataFrame(rows, DOC), goals)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"code", "prose", "log"} and all(r.reachable for r in got.values())
    assert got["code"].rate_share == pytest.approx(0.5, abs=0.01) and got["log"].rate_share == pytest.approx(0.2, abs=0.01)
    assert all(abs(r.copy_share - r.target_share) < 0.08 for r in got.values())
    cap = {"code": 3, "prose": 2, "log": 2, None: 3}
    assert all(0 <= r.copies <= cap[r.source] and r.rate <= cap[r.source] for r in copies.collect()) and copies.count() == 170


def test_short_sources(spark):
    rows = documents(spark, {"code": 50, "prose": 50, "log": 2})
    goals = spark.createDataFrame([("code", 0.4, 2), ("prose", 0.3, 2), ("log", 0.3, 4), ("absent", 0.0, 1)], GOAL)
    assert {r.source for r in M.short_sources(spark.createDataFrame(rows, DOC), goals).collect()} == {"log"}


def test_classifier_on_held_out_documents():
    rng = np.random.default_rng(0)
    names = list(KINDS)
    texts = [(k, " ".join(rng.permutation(KINDS[names[k]].split())) + f" {i}") for i in range(120) for k in range(3)]
    x, y = np.stack([M.features(t) for _, t in texts]), np.array([k for k, _ in texts])
    model = M.Classifier.fit(x[:240], y[:240], names)
    assert (model.posteriors(x[240:]).argmax(1) == y[240:]).mean() > 0.95
    assert M.features("").any() and M.Classifier.fit(x[:0], y[:0], names).posteriors(x[:2]) == pytest.approx(1 / 3)


def test_dirt(spark):
    rows = [(1, None, "code", None), (2, "", "code", None), (3, "text " * 50_000, "code", None), (3, "text " * 50_000, "code", None), (None, "x", "code", None), (4, "y z", None, None), (5, None, None, None), (6, "other", "elsewhere", None)]
    goals = spark.createDataFrame([("code", 1.0, 1), ("code", 0.5, 9), (None, 0.2, 1)], GOAL)
    docs = spark.createDataFrame(rows, DOC)
    copies, report = M.mix(docs.withColumn("tokens", F.lit("t")).withColumn("rate", F.lit(1)), goals)
    assert {r.doc_id for r in copies.collect()} == {1, 2, 3, 4, 6} and report.first().target_share == 1.0
    assert M.mix(docs.limit(0), goals)[1].first().rate_share is None and M.mix(docs, goals.limit(0))[1].count() == 0


def test_a_short_source_bounds_the_total_but_not_the_shares(spark):
    own = np.array([100.0, 600.0, 500.0])
    rate, missing, total = M.fit_mix(np.diag(own), np.array([1.0, 2.0, 2.0]), np.array([0.5, 0.3, 0.2]), own.sum(), 0.05 * own.sum())
    used = rate * own
    assert used / used.sum() == pytest.approx([0.5, 0.3, 0.2], abs=1e-3) and total == pytest.approx(200, rel=0.01) and np.abs(missing).max() < 1e-3
    # where even the least total can't be met, that is what is given, with what is missing
    rate, missing, total = M.fit_mix(np.diag(own), np.array([0.1, 2.0, 2.0]), np.array([0.5, 0.3, 0.2]), own.sum(), 0.5 * own.sum())
    assert total == pytest.approx(600) and missing[0] > 0.9 and rate[0] == pytest.approx(0.1)


def test_fit_against_bounded_least_squares():
    rng = np.random.default_rng(2)
    expected = rng.random((12, 4)) * rng.integers(1, 50, (12, 1))
    caps = rng.integers(1, 4, 12).astype(float)
    wanted = (caps * 0.4) @ expected
    rate, missing = M.fit_rates(expected, caps, wanted)
    assert np.abs(missing).max() < 1e-5 and (rate >= 0).all() and (rate <= caps).all()
    far = M.fit_rates(expected, caps, caps @ expected * 2)[0]
    assert far == pytest.approx(caps)


def test_memberships_fall_into_bounded_classes():
    rng = np.random.default_rng(1)
    posterior = rng.dirichlet(np.full(5, 0.3), 4000)
    found = M.classes_of(posterior)
    assert found.max() < 5 * 5 * M.LEVELS and (found // (5 * M.LEVELS) == posterior.argmax(1)).all()
    assert len(set(M.classes_of(np.eye(5)).tolist())) == 5 and (M.classes_of(np.ones((3, 1))) == M.classes_of(np.ones((1, 1)))[0]).all()


def test_unnamed_documents_go_by_their_posteriors(spark):
    rows = documents(spark, {"code": 60, "prose": 60, "log": 30}, unknown=200)
    goals = spark.createDataFrame([("code", 0.4, 1), ("prose", 0.3, 1), ("log", 0.3, 1)], GOAL)
    copies, report = M.mix(spark.createDataFrame(rows, DOC), goals)
    got = {r.source: r for r in report.collect()}
    assert all(abs(r.rate_share - r.target_share) < 0.001 and abs(r.residual) < 1e-3 for r in got.values())
    assert {r.rate < 1 for r in copies.filter("source is null").collect()} == {True} or got["log"].used_tokens > 0


def test_short_sources_come_from_the_whole_mix(spark, monkeypatch):
    docs = spark.createDataFrame(documents(spark, {"code": 50, "prose": 50, "log": 2}, unknown=30), DOC)
    goals = spark.createDataFrame([("code", 0.4, 2), ("prose", 0.3, 2), ("log", 0.3, 4)], GOAL)
    fitted, fit = [], M.fit_classifier
    monkeypatch.setattr(M, "fit_classifier", lambda *given: fitted.append(fit(*given)) or fitted[-1])
    # unnamed logs would do for the share, but only a source's own documents count
    assert {r.source for r in M.short_sources(docs, goals).collect()} == {"log"}
    assert len(fitted) == 1 and fitted[0].posteriors(M.features(f"{KINDS['log']} 7 " * 4)[None])[0].argmax() == fitted[0].sources.index("log")
    # the fit decides: nothing left missing, nothing short
    rates = M.fit_rates
    monkeypatch.setattr(M, "fit_rates", lambda *given: (rates(*given)[0], np.zeros(len(given[2]))))
    assert M.short_sources(docs, goals).count() == 0


def test_a_source_is_short_when_tokens_are_missing_at_the_cap():
    def short(own, shares, repeats):
        return M._short(np.diag(np.array(own, float)), np.array(repeats, float), M.Goals([str(i) for i in range(len(own))], np.array(shares), np.array(repeats, float)))

    assert short([10, 90, 0], [0.2, 0.7, 0.1], [2, 1, 5]) == [False, False, True]
    assert short([10, 90], [0.2 + 1e-9, 0.7], [2, 1]) == [True, False]
    # rates far from one are fitted with less care than their caps are kept
    assert short([3, 10**10], [0.5, 1e-10], [10**9, 1]) == [True, False] and short([3, 10**10], [0.5, 1e-10], [10**10, 1]) == [False, False]
    assert short([5, 5], [0.5, 0.0], [0, 0]) == [True, False] and short([0, 0], [0.5, 0.5], [1, 1]) == [False, False]


def test_texts_of_one_id_count_each(spark):
    rows = [(1, "one two", "code", None), (1, "two one", " CODE", None), (1, "two one", "code", None), (2, "one two", "prose", None)]
    assert len(set(M.token_counts(["one two", "two one"]))) == 1
    docs, goals = spark.createDataFrame(rows, DOC), spark.createDataFrame([("code", 0.6, 1), ("prose", 0.3, 1)], GOAL)
    assert M.short_sources(docs, goals).count() == 0
    assert {r.source: r.own_tokens for r in M.mix(docs, goals)[1].collect()} == {"code": 4, "prose": 2}


def test_many_repeats(spark):
    goals = spark.createDataFrame([("code", 0.5, 10**12), ("prose", 0.5, 1)], "source string, target_share double, max_repeats long")
    assert M.short_sources(spark.createDataFrame(documents(spark, {"code": 2, "prose": 3}), DOC), goals).count() == 0
