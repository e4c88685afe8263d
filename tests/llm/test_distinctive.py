import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import distinctive as D

POSTING = "term string, node_id long, line long, weight double"


def tables(spark, rows, nodes):
    return spark.createDataFrame(rows, POSTING), spark.createDataFrame([(n, "x") for n in nodes], "node_id long, source string")


def brute(rows, nodes, share=D.OWN_SHARE):
    """The same model one node at a time."""
    clean = {r for r in rows if None not in (r[0], r[1]) and r[3] in D.VALID_WEIGHTS and r[1] in nodes}
    weight, total = {}, {}
    for term, node, _, w in clean:
        weight.setdefault(node, {}).setdefault(term, 0.0)
        weight[node][term] += w
        total[term] = total.get(term, 0.0) + w
    whole = sum(total.values())
    out = {}
    for node, own in weight.items():
        size = sum(own.values())
        p = {t: w / size for t, w in own.items()}
        for _ in range(200):
            e = {t: w * share * p[t] / ((1 - share) * total[t] / whole + share * p[t]) for t, w in own.items()}
            p = {t: v / sum(e.values()) for t, v in e.items()}
        out[node] = p
    return out


ROWS = [("common", n, i, 1.0) for n in range(6) for i in range(8)] + [(f"own{n}", n, i, 1.0) for n in range(6) for i in range(5)] + [("own0", 1, 0, 1.0)]
DIRT = [("common", 0, 0, 1.0)] * 5 + [(None, 0, 0, 1.0), ("own0", None, 0, 1.0), ("bad", 0, 0, 7.0), ("bad", 0, 0, float("nan")), ("bad", 0, 0, None), ("ghost", 99, 0, 3.0), ("own2", 2, None, 2.0)]


@pytest.mark.parametrize("large", [D.LARGE_NODE, 1])
def test_scores_match_brute_force_and_shares_sum_to_one(spark, large):
    found = D.score_terms(*tables(spark, ROWS + DIRT, range(6)), large_node=large)
    want = brute(ROWS + DIRT, set(range(6)))
    got = {(r.node_id, r.term): r.score for r in found.collect()}
    assert set(got) == {(n, t) for n, p in want.items() for t in p}
    assert all(got[n, t] == pytest.approx(v, abs=1e-5) for n, p in want.items() for t, v in p.items())
    assert all(r.s == pytest.approx(1) for r in found.groupBy("node_id").agg(F.sum("score").alias("s")).collect())
    assert {r.node_id: r.term for r in D.most_distinctive(found).collect()} == {n: f"own{n}" for n in range(6)}


def test_ties_empty_and_clashing_columns(spark):
    postings, nodes = tables(spark, [("b", 1, 0, 1.0), ("a", 1, 1, 1.0)], [1, 1, None])
    assert D.most_distinctive(D.score_terms(postings.withColumn("score", F.lit(1)).withColumn("background", F.lit(2)), nodes.withColumn("term", F.lit("z")))).first().term == "a"
    empty, _ = tables(spark, [], [])
    assert D.score_terms(empty, nodes).count() == 0 and D.score_terms(postings, nodes.limit(0)).count() == 0


def test_models_of_many_nodes_at_once():
    owner = np.array([1, 1, 2, 2, 2])
    both = D.fit_models(owner, np.array([5.0, 5, 1, 2, 3]), np.array([0.5, 0.01, 0.2, 0.2, 0.2]))
    alone = D.fit_models(owner[:2], np.array([5.0, 5]), np.array([0.5, 0.01]))
    assert both[:2] == pytest.approx(alone, abs=1e-6) and both[1] > 0.99 and D.fit_models(owner[:0], owner[:0], owner[:0]).size == 0


def test_a_model_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(3)
    owners = [(i, rng.integers(1, 4, n).astype(float), rng.random(n) * 0.01) for i, n in enumerate((5, 40, 3, 17))]
    alone = [D.fit_models(np.full(len(w), i), w, b) for i, w, b in owners]
    together = D.fit_models(np.concatenate([np.full(len(w), i) for i, w, b in owners]), np.concatenate([w for _, w, _ in owners]), np.concatenate([b for *_, b in owners]))
    assert (np.concatenate(alone) == together).all()


def test_large_nodes_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "LARGE_AT_ONCE", 2)
    rng = np.random.default_rng(6)
    rows = [(f"t{rng.integers(0, 30)}", int(n), int(line), float(rng.integers(1, 4))) for n in range(6) for line in range(40)]
    postings = spark.createDataFrame(rows, "term string, node_id long, line long, weight double")
    nodes = spark.createDataFrame([(n,) for n in range(6)], "node_id long")
    scores = lambda large: {(r.node_id, r.term): round(r.score, 7) for r in D.score_terms(postings, nodes, large_node=large).collect()}
    assert scores(5) == scores(10_000)
