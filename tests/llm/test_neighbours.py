from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import neighbours as N
from lodestack.llm.graphindex import build, search


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, vectors, ids=None):
    ids = ids or [f"v{i:05d}" for i in range(len(vectors))]
    return spark.createDataFrame([(i, bytearray(v.astype("<f4").tobytes())) for i, v in zip(ids, vectors)], "id string, unit binary")


def clustered(n, dims=16, groups=60, seed=1):
    rng = np.random.default_rng(seed)
    return unit(rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dims)))


@pytest.mark.parametrize("n", [0, 1, 2, 40, 3000])
def test_graph_recall_against_brute_force(n):
    x = clustered(n) if n else np.zeros((0, 16), np.float32)
    graph = build(x, top=200)
    ids, sims = search(graph, x[:200], 5, width=24)
    if n > 5:
        exact = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, exact)]) > 0.97
    assert (ids < max(n, 1)).all() and (np.diff(sims, axis=1)[np.isfinite(sims[:, 1:])] <= 0).all()
    assert len(graph.layers) >= 1 and all(layer.links.dtype == np.int32 or len(layer.nodes) < 2 for layer in graph.layers)


def test_sharded_recall_against_brute_force(spark):
    x = clustered(3000)
    found = N.nearest(frame(spark, x), k=10, dims=16, shard_rows=300, probes=3).toPandas()
    exact = x @ x.T
    np.fill_diagonal(exact, -1)
    truth = np.argsort(-exact, axis=1)[:, :10]
    got = found.groupby("id")["neighbour"].apply(set)
    recall = np.mean([len({f"v{j:05d}" for j in truth[i]} & got.get(f"v{i:05d}", set())) / 10 for i in range(3000)])
    assert recall > 0.9 and found.groupby("id").size().max() <= 10
    asked = spark.createDataFrame([("v00007",), ("nobody",)], "id string")
    some = N.nearest(frame(spark, x), k=3, dims=16, shard_rows=300, queries=asked).collect()
    assert {r.id for r in some} == {"v00007"} and sorted(r["rank"] for r in some) == [1, 2, 3]


def test_copies_share_one_search_and_tie_by_id(spark):
    base = clustered(30)
    x = np.concatenate([base, np.repeat(base[:1], 20, 0)])
    found = N.nearest(frame(spark, x), k=10, dims=16, min_similarity=0.999).toPandas()
    copies = ["v00000"] + [f"v{i:05d}" for i in range(30, 50)]
    for one in copies:
        mine = found[found.id == one].sort_values("rank")["neighbour"].tolist()
        assert mine == [c for c in copies if c != one][:10]


T = datetime(2026, 1, 1)
STORE = "chunk_id string, file_alias string, encrypted_body string, nonce string, embedding array<double>, content_hash string, updated_at timestamp, arrived_at timestamp"


def test_pairs_of_current_rows(spark):
    e = lambda *v: [float(x) for x in v] + [0.0] * (64 - len(v))
    row = lambda c, v, day, h="h": (c, None, None, None, v, h, T + timedelta(days=day), T)
    rows = [
        row("a", e(1, 0), 1), row("a", e(1, 0), 1), row("b", e(5, 0.1), 1), row("c", e(0, 1), 1), row("c", e(1, 0), 0),
        row("d", e(1, 0), 1, None), row("e", None, 2), row("f", [1.0], 2), row("g", e(float("nan")), 2), row("h", e(0, 0), 2), row("i", [None] + [1.0] * 63, 2),
        row(None, e(1, 0), 1), row("j", e(0, 3e200, 1e190), 1), row("k", e(1, 0), 1), row("k", None, 3),
    ]
    store = spark.createDataFrame(rows, STORE).withColumn("rank", F.lit(1)).withColumn("unit", F.lit(1))
    assert {tuple(r) for r in N.similar_pairs(store).collect()} == {("a", "b"), ("c", "j")}
    assert N.similar_pairs(store.limit(0)).count() == 0


def recall_of(found, x, k, ids=None):
    exact = x @ x.T
    np.fill_diagonal(exact, -2)
    truth = np.argsort(-exact, axis=1)[:, :k]
    got = found.groupby("id")["neighbour"].apply(set)
    asked = range(len(x)) if ids is None else ids
    return np.mean([len({f"v{j:05d}" for j in truth[i]} & got.get(f"v{i:05d}", set())) / k for i in asked])


def test_a_stored_index_answers_later_queries(spark):
    x = clustered(2000)
    vectors = frame(spark, x)
    index = N.GraphIndex.build(vectors, dims=16, shard_rows=300)
    assert index.graphs.count() == len({r.shard for r in index.graphs.select("shard").collect()}) and sum(len(r.ids) for r in index.graphs.collect()) == 2000
    ids = list(range(0, 2000, 50))
    asked = frame(spark, x[ids], [f"v{i:05d}" for i in ids])
    found = index.search(asked, 10, probes=3).toPandas()
    assert recall_of(found, x, 10, ids) > 0.9 and (found["id"] != found["neighbour"]).all()
    strangers = frame(spark, clustered(5, seed=9), [f"q{i}" for i in range(5)])
    assert index.search(strangers, 3).groupBy("id").count().filter("count = 3").count() == 5
    assert index.search(vectors.limit(0)).count() == 0
    assert N.GraphIndex.build(vectors.limit(0), dims=16).search(asked).count() == 0


def test_cells_of_two_levels_find_the_nearest():
    x = clustered(6000, groups=300)
    two, one = N.Cells.fit(x, 6000, 20, one_level=16), N.Cells.fit(x, 6000, 20)
    assert len(two.coarse) > 1 and len(one.coarse) == 1 and abs(len(two.fine) - len(one.fine)) < 60
    near = two.nearest(x, 3)
    exact = (x @ two.fine.T).argmax(1)
    assert (near[:, 0] == exact).mean() > 0.97 and len(np.unique(near[0])) == 3
    crowd = N.Cells.fit(np.repeat(x[:1], 4000, 0), 4000, 100)
    assert crowd.splits.sum() >= 4000 // 300


def test_hot_copies_are_spread(spark):
    base = clustered(40)
    x = np.concatenate([base, np.repeat(base[:1], 60, 0), np.repeat(base[1:2], 3, 0)])
    plain = {tuple(r) for r in N.nearest(frame(spark, x), k=5, dims=16).select("id", "neighbour", "rank").collect()}
    assert plain == {tuple(r) for r in N.nearest(frame(spark, x), k=5, dims=16, hot_copies=7).select("id", "neighbour", "rank").collect()}
    assert len(plain) == 5 * len(x)
