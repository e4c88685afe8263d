import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestack.functions.vectors import cosine, feature_vector
from lodestack.operators import community, context, fusion, graph, lexical, memory, merkle, pagerank
from lodestack.plans import retrieval


def test_lexical_decay_and_dirt(spark):
    rows = [("alpha", 1, 0, 3.0), ("beta", 1, 2, 1.0), ("alpha", 2, 0, 1.0), ("alpha", 3, 0, float("nan")), (None, 4, 0, 1.0), ("alpha", None, 0, 1.0), ("alpha", 5, 0, -1.0)]
    postings = spark.createDataFrame(rows, "term string, node_id long, line long, weight double")
    got = [(r.node_id, r.score) for r in lexical.lexical_search(postings, "Alpha beta").collect()]
    assert got[0][0] == 1 and got[0][1] == pytest.approx(4 * math.exp(-1 / 3)) and got[1] == (2, 1.0) and len(got) == 2
    assert lexical.lexical_search(postings, "  ").count() == 0 and lexical.lexical_search(postings, "alpha", 0).count() == 0
    assert lexical.terms_of("AutocompleteRequest search_engine search") == ["autocomplete", "request", "search", "engine"]


def test_trigrams(spark):
    chunks = spark.createDataFrame([("short", "foo"), ("long", "foo bar baz qux"), ("none", None), ("empty", "")], "chunk_id string, text string")
    assert lexical.trigram_search(chunks, "foo bar").first().id == "long"
    index = lexical.trigram_index(chunks)
    swapped = lexical.replace_chunks(index, spark.createDataFrame([("long", "zzz")], "chunk_id string, text string"))
    assert {r.gram for r in swapped.filter("id = 'long'").collect()} == {"zzz"}
    assert lexical.remove_chunks(index, spark.createDataFrame([("long",)], "id string")).filter("id = 'long'").count() == 0


def test_trigrams_of_whole_sources(spark, tmp_path):
    rows = [(1, "ab", "Abcabc"), (1, "ab", "Abcabc"), (2, "x", "BCA"), (3, "y", "é"), (4, "z", ""), (5, "z", None), (None, "z", "abc")]
    spark.createDataFrame(rows, "node_id long, name string, source string").write.parquet(str(tmp_path / "nodes.parquet"))
    got = {(r.gram, r.chunks, r.occurrences) for r in retrieval.QUERIES["trigram_source_postings"](spark, str(tmp_path)).collect()}
    assert got == {("abc", 1, 2), ("bca", 2, 2), ("cab", 1, 1), ("é", 1, 1)}


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([], [1.0], 0), ([0.0, 0.0], [1.0, 1.0], 0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_fallback_vectors():
    v = feature_vector("chunk index of chunks")
    assert abs(float(v @ v) - 1) < 1e-9 and float(v @ feature_vector("chunk index")) > float(v @ feature_vector("zebra")) and not feature_vector("").any()


def _fuse(spark, rows, settings=None, structural=None, count=2):
    streams = spark.createDataFrame(rows, "stream int, pos int, id long, score double")
    out = fusion.best_fused(fusion.fuse(streams, count, settings, structural), 10)
    return [(r.id, r.fused) for r in out.orderBy("position").collect()]


def test_rrf(spark):
    rows = [(0, 0, 1, 9.0), (0, 1, 2, 5.0), (0, 2, 3, 1.0), (1, 0, 2, 0.9), (1, 1, 1, 0.8)]
    plain = _fuse(spark, rows, fusion.FusionSettings(weights=[1, 1]))
    assert [i for i, _ in plain] == [1, 2, 3] and plain[0][1] == pytest.approx(0.0330601093) and plain[2][1] == pytest.approx(0.0161290323)
    scored = dict(_fuse(spark, rows, fusion.FusionSettings(alpha=0.5, weights=[2, 1])))
    assert scored[1] == pytest.approx(0.049726776) and scored[2] == pytest.approx(0.0495884774) and scored[3] == pytest.approx(0.0322580645)
    tie = spark.createDataFrame([(2, 5.0), (1, 1.0)], "id long, score double")
    assert _fuse(spark, rows, fusion.FusionSettings(weights=[1, 1]), tie)[0][0] == 2
    doubled = _fuse(spark, [(0, 0, 7, 1.0), (0, 1, 7, 1.0), (0, 1, 7, 1.0)])
    assert doubled == [(7, pytest.approx(1 / 60))]
    assert _fuse(spark, []) == []
    bad = fusion.FusionSettings(k=float("nan"), alpha=float("inf"), weights=[float("nan"), -1])
    assert (bad.safe_k(), bad.safe_alpha(), bad.safe_weights(2)) == (60.0, 0.0, [0.0, 0.0])


def _graph(spark, ids, edges):
    return spark.createDataFrame([(i, f"t{i}", f"n{i}", "fn", float(i)) for i in ids], "node_id long, tracker_id string, name string, kind string, pagerank double"), spark.createDataFrame(edges, "src long, dst long, kind string")


def scores(df):
    return {r.node_id: r.score for r in df.collect()}


def test_pagerank_both_ways_agree(spark):
    nodes, edges = _graph(spark, range(3), [(0, 1, "calls"), (0, 2, "contains"), (9, 1, "calls"), (2, 2, "calls")])
    got = scores(pagerank.pagerank(nodes, edges))
    assert got[0] == pytest.approx(0.25974026, abs=1e-6) and got[1] == pytest.approx(0.45172219, abs=1e-6) and sum(got.values()) == pytest.approx(1)
    seeds = spark.createDataFrame([(0, 1.0), (0, float("nan")), (77, 3.0), (1, -2.0)], "node_id long, seed double")
    seeded = scores(pagerank.pagerank(nodes, edges, seeds, rounds=8))
    joined = scores(pagerank.pagerank(nodes, edges, seeds, rounds=8, small_edges=0))
    assert all(seeded[i] == pytest.approx(joined[i], abs=1e-9) for i in seeded)
    one, none = _graph(spark, [0], [])
    assert scores(pagerank.pagerank(one, none, damping=float("nan"), rounds=0, epsilon=float("nan"))) == {0: pytest.approx(1.0)}
    empty, _ = _graph(spark, [], [])
    assert pagerank.pagerank(empty, none).count() == 0


def test_star_and_seed_builders(spark):
    nodes, edges = _graph(spark, range(4), [(i, 3, "calls") for i in range(3)] + [(0, 3, "references"), (1, 2, "implements")])
    got = scores(pagerank.pagerank(nodes, edges))
    assert max(got, key=got.get) == 3
    assert {r.node_id for r in pagerank.foundational_seeds(nodes, edges).collect()} == {2}
    named = spark.createDataFrame([(0, "crate::a::b::fn::x"), (1, "crate::a::c::fn::y"), (2, "crate::fn::z")], "node_id long, tracker_id string")
    assert {r.node_id: r.seed for r in pagerank.module_seeds(named, ["a::b"], 0.5).collect()} == {0: 1.0, 1: 0.5, 2: 0.25}


TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def test_communities(spark):
    nodes, edges = _graph(spark, range(6), [(a, b, "calls") for a, b in TRIANGLES])
    found = {r.node_id: r.community for r in community.communities(nodes, edges).collect()}
    assert [found[i] for i in range(6)] == [0, 0, 0, 1, 1, 1]
    near = scores(community.proximity(edges, community.communities(nodes, edges), 0))
    assert near[0] == 1.0 and near[4] == 0.5
    large = {r.node_id: r.community for r in community.communities(nodes, edges, small_edges=0).collect()}
    assert len(large) == 6 and large[0] == large[1] == large[2] and large[3] == large[4] == large[5]
    assert community.modularity(nodes, edges, community.communities(nodes, edges)).first()[0] == pytest.approx(0.357143)
    empty, none = _graph(spark, [], [])
    assert community.communities(empty, none).count() == 0


def test_communities_are_the_same_wherever_they_are_found(spark):
    rng = random.Random(3)
    ends = [(rng.randrange(120), rng.randrange(120)) for _ in range(260)]
    nodes, edges = _graph(spark, range(125), [(a, b, rng.choice(["calls", "references", "contains"])) for a, b in ends])
    small = {tuple(r) for r in community.communities(nodes, edges).collect()}
    assert len(small) == 125 and {tuple(r) for r in community.communities(nodes, edges, small_edges=0).collect()} == small
    empty, none = _graph(spark, [], [])
    assert community.communities(empty, none, small_edges=-1).count() == 0


def test_communities_that_still_move_raise(spark):
    nodes, edges = _graph(spark, range(6), [(a, b, "calls") for a, b in TRIANGLES])
    for small_edges in (0, 100):
        with pytest.raises(Exception, match="still move after 1 sweeps"):
            community.communities(nodes, edges, small_edges=small_edges, sweeps=1).collect()


def test_connected_parts_split_labels(spark):
    ids = spark.range(4).withColumnRenamed("id", "node_id")
    pairs = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "a long, b long, w double")
    same = ids.withColumn("community", F.lit(7).cast("long"))
    assert {r.node_id: r.part for r in community.connected(ids, pairs, same).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_graph_lookups(spark):
    nodes, edges = _graph(spark, [0, 1, 1, 2], [(0, 1, "calls"), (0, 1, "calls"), (1, 0, "references"), (2, 2, "calls"), (None, 1, "calls"), (1, 9, "calls")])
    assert scores(graph.dependency_scores(nodes, edges)) == {0: 0.7, 1: 1.0, 2: 0.0}
    assert [(r.node_id, r.pagerank) for r in graph.top_nodes(nodes, 2).collect()] == [(2, 2.0), (1, 1.0)]
    assert graph.neighbourhood(nodes, edges, 0).count() == 2
    document = graph.graph_document(nodes, edges)
    assert {tuple(r) for r in graph.edges_of_document(document).collect()} == {(0, 1, "calls"), (1, 0, "references")}
    chain = spark.createDataFrame([(i, i + 1, "calls") for i in range(30)], "src long, dst long, kind string")
    start = spark.createDataFrame([(0,)], "node_id long")
    assert graph.reachable(chain, start, limit=5).count() == 5 and graph.reachable(chain, start, limit=None).count() == 31
    rows = graph.dense_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), ["k"])
    assert {r.k: r.dense_id for r in rows.collect()} == {"a": 0, "b": 1, "c": 2}


def test_merkle(spark):
    leaves = lambda rows: spark.createDataFrame(rows, "chunk_id string, hash string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    two = [("f2", digest("bbb")), ("f1", digest("aaa"))]
    assert merkle.merkle_root(leaves(two)).first().root == "68982e04566849e2c5f873a762cdb21e6a75aab6c11dea0565473e2ff28ae4f7"
    three = [*two, ("f3", digest("ccc"))]
    assert merkle.merkle_root(leaves(three)).first().root == "d6d195234e6a8f85ff9c7052b9cf7e62a5cfdae84ca23f6fc1cedf5e21f6765a"
    assert merkle.merkle_levels(leaves(three)).orderBy(F.desc("level")).first().hash == merkle.merkle_root(leaves(three[::-1])).first().root
    assert merkle.merkle_root(leaves([])).count() == 0
    change = {(r.chunk_id, r.change) for r in merkle.tree_diff(leaves([("keep", "1"), ("drop", "2"), ("edit", "3")]), leaves([("keep", "1"), ("new", "4"), ("edit", "5")])).collect()}
    assert change == {("drop", "deleted"), ("new", "changed"), ("edit", "changed")}


def test_vector_sync(spark):
    chunks = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("b", "h2")], "chunk_id string, content_hash string")
    synced = spark.createDataFrame([("a", "h1")], "chunk_id string, content_hash string")
    got = {r.chunk_id: (r.action, r.remote_id[:2]) for r in merkle.sync_chunks(chunks, synced, "k").collect()}
    assert got == {"a": ("skip", "c_"), "b": ("upsert", "c_")}
    key = bytes(range(32))
    sealed = spark.createDataFrame([("text ü",)], "t string").select(merkle.decrypt(merkle.encrypt(F.col("t"), key), key))
    assert sealed.first()[0] == "text ü"


def test_memories(spark):
    rows = [("m1", "design decision about auth", None, 0, 0, 7, 0.95), ("m2", "other", "x", 0, 0, 0, 0.5)]
    kept = spark.createDataFrame(rows, "id string, content string, namespace string, created_at long, last_accessed long, access_count long, importance double")
    value = kept.select(memory.decay(F.col("importance"), F.col("last_accessed"), F.col("access_count"), 1800)).first()[0]
    assert value == pytest.approx(2.2903641367)
    text = spark.createDataFrame([("This is a design decision about auth", "ns", None, 5.0, -1.0)], "c string, n string, g double, hi double, lo double")
    got = text.select(memory.importance(F.col("g"), F.col("c"), F.col("n")), memory.importance(F.col("hi"), F.col("c"), F.col("n")), memory.importance(F.col("lo"), F.col("c"), F.col("n"))).first()
    assert got[0] == pytest.approx(0.88) and got[1:] == (1.0, 0.0)
    assert [r.id for r in memory.recall(kept, "AUTH design", 1800).collect()] == ["m1"]
    assert memory.touch(kept, "m1", 5).filter("id = 'm1'").first().access_count == 8
    assert memory.prune(kept, 86_400 * 100, 0.01).count() == 0
    assert memory.update(kept, "m2").filter("id = 'm2'").first().namespace is None


def test_recency(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2023-12-31 00:00:00")], "node_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-01 00:02:00").cast("timestamp")
    got = {r.node_id: r.boost for r in memory.boosts(events, now).collect()}
    assert got == {1: pytest.approx(2.1213203436)}
    seeds = spark.createDataFrame([(1, 1.0), (3, 2.0)], "node_id long, seed double")
    assert {r.node_id: r.seed for r in memory.boosted_seeds(seeds, memory.boosts(events, now)).collect()} == {1: pytest.approx(3.1213203436), 3: 2.0}


def test_context(spark):
    text = spark.createDataFrame([("αβ\nγδε gamma\nthree",)], "t string")
    offset = text.select(context.byte_offset(F.col("t"), F.lit(1), F.lit(4))).first()[0]
    assert "αβ\nγδε gamma\nthree".encode()[offset:].decode() == "gamma\nthree"
    nodes = spark.createDataFrame([(1, "f", 0, 100), (2, "f", 10, 20), (3, "f", 20, 10), (4, "g", 0, 5)], "node_id long, file_path string, range_start long, range_end long")
    cursors = spark.createDataFrame([(0, "f", 20), (1, "f", 21), (2, "f", 500), (3, None, 1)], "cursor_id long, file_path string, offset long")
    assert {r.cursor_id: r.node_id for r in context.node_at_cursor(nodes, cursors, 8).collect()} == {0: 2, 1: 1}
    deps = spark.createDataFrame([([("a", 10), ("a", 10), ("b", 95), ("c", 8)],)], "d array<struct<text: string, tokens: bigint>>")
    assert [d.text for d in deps.select(context.pack(F.col("d"), 100, 3)).first()[0]] == ["a", "c"]
    assert deps.select(context.assemble(F.lit("s"), F.col("d"), 22)).first()[0] == "s\n// dep 1\na\n// dep 2\na"
