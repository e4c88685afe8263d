import random

import pytest
from pyspark.sql import functions as F

from lodestack.llm import ranks as R

LONG = "query_id long, node_id long, metric string, value double"


def brute(rows, missing="worst", weights=None):
    metrics = sorted({r[2] for r in rows})
    out = {}
    for q in {r[0] for r in rows}:
        nodes = sorted({r[1] for r in rows if r[0] == q})
        points = dict.fromkeys(nodes, 0.0)
        for m in metrics:
            have = {n: v for a, n, b, v in rows if a == q and b == m and v is not None}
            if not any(a == q and b == m for a, _, b, _ in rows):
                continue
            for n in nodes:
                if n in have:
                    rank = sum(v > have[n] for v in have.values()) + (sum(v == have[n] for v in have.values()) + 1) / 2
                else:
                    rank = (len(nodes) + len(have) + 1) / 2 if missing == "worst" else (len(nodes) + 1) / 2
                points[n] += (weights or {}).get(m, 1.0) * (len(nodes) - rank)
        order = sorted(nodes, key=lambda n: (-round(points[n], 6), n))
        out |= {(q, n): (round(points[n], 6), i + 1) for i, n in enumerate(order)}
    return out


@pytest.mark.parametrize("large", [R.LARGE_GROUP, 2])
@pytest.mark.parametrize("missing", ["worst", "middle"])
def test_borda_matches_brute_force(spark, large, missing):
    rng = random.Random(large)
    rows = [(q, n, m, rng.choice([None, 0.0, 0.0, 1.0, rng.random(), 1e9 * rng.random()])) for q in range(3) for n in range(60) for m in ("a", "b", "c")]
    weights = {"a": 2.0}
    got = R.borda(spark.createDataFrame(rows, LONG), weights, missing, large).collect()
    assert {(r.query_id, r.node_id): (r.points, r.position) for r in got} == brute(rows, missing, weights)


def test_scale_of_a_score_does_not_matter(spark):
    rows = [(1, n, m, float(v)) for n, (a, b) in enumerate([(3, 1), (2, 2), (1, 3), (0, 2.5)]) for m, v in (("a", a), ("b", b))]
    plain = R.borda(spark.createDataFrame(rows, LONG)).orderBy("position").select("node_id").collect()
    scaled = R.borda(spark.createDataFrame([(q, n, m, v * 1e12 if m == "b" else v) for q, n, m, v in rows], LONG)).orderBy("position").select("node_id").collect()
    assert plain == scaled
    with pytest.raises(ValueError):
        R.borda(spark.createDataFrame(rows, LONG), missing="best")


def test_hits_with_dirt(spark):
    schema = "query_id long, node_id long, pagerank double, rrf_score double, scores map<string,double>, metric string"
    rows = [
        (1, 1, 0.5, 0.1, {"lexical": 9.0, "semantic": float("nan")}, "m"), (1, 1, 0.5, 0.1, {"lexical": 9.0, "semantic": float("nan")}, "m"),
        (1, 2, None, None, None, "m"), (1, 3, float("nan"), 0.9, {"lexical": 1.0}, None), (None, 4, 1.0, 1.0, {}, "m"), (1, None, 1.0, 1.0, {}, "m"), (2, 7, None, None, {}, "m"),
    ]
    hits = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in R.best_nodes(hits, 2).collect()} == {(1, 1), (1, 3), (2, 7)}
    assert R.best_nodes(hits.limit(0)).count() == 0
    streams = spark.createDataFrame([(1, 0, 0, 5, 2.0), (1, 0, 1, 5, 9.0), (1, 0, 2, 6, 3.0), (1, 0, 2, 6, 3.0), (1, 0, None, 7, 1.0)], "query_id long, stream int, pos int, id long, score double")
    assert {(r.node_id, r.value) for r in R.stream_scores(streams).collect()} == {(5, 2.0), (6, 3.0)}
    assert R.long_scores(hits).filter(F.isnan("value")).count() == 0
