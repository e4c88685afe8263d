import json
import warnings

import numpy as np
import pytest

from lodestack import runtime
from lodestack.functions.vectors import feature_vector, model_embedding
from lodestack.operators import build, compress, fusion, indexing, lexical, memory, merkle, pagerank
from lodestack.service import Engine
from lodestack.sources.files import Store, normal
from lodestack.streaming import changes

CHUNKS = "chunk_id string, file_path string, source string, content_hash string"


def chunk_rows(texts):
    return [(f"{path}::{name}", path, text, f"h{hash(text)}") for path, name, text in texts]


def same(index, rebuilt):
    for name, columns in (("chunks", ["chunk_id", "content_hash"]), ("trigrams", ["gram", "id", "n"]), ("sizes", ["id", "grams"]), ("synced", ["chunk_id", "content_hash", "remote_id"])):
        a, b = ({tuple(r) for r in getattr(x, name).select(*columns).collect()} for x in (index, rebuilt))
        assert a == b, name
    assert index.root == rebuilt.root


def test_an_updated_index_is_the_index_of_the_new_files(spark):
    old = chunk_rows([("a.rs", "f", "fn alpha() {}"), ("a.rs", "g", "fn beta() {}"), ("b.rs", "h", "fn gamma() {}")])
    index = indexing.ChunkIndex.build(spark.createDataFrame([*old, old[0], (None, "c.rs", "x", "y")], CHUNKS), "k")
    fresh = chunk_rows([("a.rs", "f", "fn alpha() {}"), ("a.rs", "i", "fn delta() {}")])
    after, report = index.update(spark.createDataFrame(fresh, CHUNKS), spark.createDataFrame([("./a.rs",), ("a.rs",), (None,)], "path string"))
    assert (report["changed"], report["deleted"], report["upserted"], report["skipped"]) == (1, 1, 1, 2)
    same(after, indexing.ChunkIndex.build(spark.createDataFrame([old[2], *fresh], CHUNKS), "k"))
    assert after.search("delta", 1).first().id == "a.rs::i" and {r.file_path for r in after.indexed_files().collect()} == {"a.rs", "b.rs"}
    empty, report = after.update(spark.createDataFrame([], CHUNKS), spark.createDataFrame([("a.rs",), ("b.rs",)], "path string"))
    assert report["deleted"] == 3 and empty.root is None and empty.search("delta").count() == 0
    empty.release()


def test_keeper_applies_a_batch_once(spark):
    index = indexing.ChunkIndex.build(spark.createDataFrame(chunk_rows([("a.rs", "f", "one two")]), CHUNKS), "k")
    now = spark.createDataFrame(chunk_rows([("a.rs", "f", "three four")]), CHUNKS)
    keeper = changes.IndexKeeper(index, lambda paths: paths, lambda paths: now.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(*indexing.CHUNK))
    batch = spark.createDataFrame([("a.rs", "modified"), ("a.rs", "created")], "path string, kind string")
    for number in (0, 0, 1):
        keeper.apply(batch, number)
    assert [r["changed"] for r in keeper.reports] == [1, 0] and keeper.index.search("three", 1).first().id == "a.rs::f"


def test_index_search_is_trigram_search(spark):
    texts = [(i, t) for i, t in enumerate(["token budget", "the token budget token", "", "to", "aaaa", "budget of tokens and tokens", None])]
    rows = spark.createDataFrame(texts, "chunk_id long, text string")
    index = lexical.trigram_index(rows)
    for query in ("token budget", "aaa", "to", "", "zzz"):
        a = [tuple(r) for r in lexical.trigram_search(rows, query, 5).collect()]
        assert a == [tuple(r) for r in lexical.index_search(index, lexical.gram_sizes(index), query, 5).collect()], query
    assert lexical.index_search(index, lexical.gram_sizes(index), "token", 0).count() == 0


def test_streams_are_numbered_alike_with_and_without_a_bound(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(50)] + [(99, float("nan")), (98, None), (None, 1.0)], "node_id long, score double")
    whole = [tuple(r) for r in fusion.as_stream(rows, 2).orderBy("pos").select("stream", "pos", "id").collect()]
    assert whole[:12] == [tuple(r) for r in fusion.as_stream(rows, 2, most=12).orderBy("pos").select("stream", "pos", "id").collect()]
    assert [p for _, p, _ in whole] == list(range(52)) and whole[0][2] == 99 and whole[-1][2] == 98


def test_block_search_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6))
    x[3] = x[8]
    x[5] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (None, x[0].tolist()), (501, x[1, :4].tolist())], "node_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (3, 5, 7, 40)] + [(900, x[2, :3].tolist())], "q long, v array<double>")

    def cos(a, b):
        n = min(len(a), len(b))
        size = np.linalg.norm(a[:n]) * np.linalg.norm(b[:n])
        return a[:n] @ b[:n] / size if size else 0.0

    every = {i: v for i, v in enumerate(x)} | {501: x[1, :4]}
    for block in (2, 2_048):
        got = {(r.query, r["rank"]): r.node_id for r in fusion.semantic_block(vectors, queries, 5, block=block).collect()}
        for q, v in [(i, x[i]) for i in (3, 5, 7, 40)] + [(900, x[2, :3])]:
            best = [n for n, s in sorted(((n, cos(v, w)) for n, w in every.items()), key=lambda t: (-round(t[1], 12), t[0])) if s >= fusion.FLOOR][:5]
            assert [got[q, r + 1] for r in range(len(best))] == best
    assert fusion.semantic_block(vectors.limit(0), queries, 5).count() == 0 and fusion.semantic_block(vectors, queries.limit(0), 5).count() == 0


def test_store_keeps_the_version_that_is_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.save("t", spark.range(3))
    held = store.load("t")
    store.save("t", store.load("t").union(spark.range(4)))
    assert held.count() == 3 and store.load("t").count() == 7
    store.save("t", spark.range(1))
    assert store.load("t").count() == 1 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v") and p.is_dir()]) == 2
    assert normal(".//a\\b//c/") == "a/b/c"


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://h:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_folder(Session)


def test_release_removes_files(spark):
    from pathlib import Path

    def inside(place):
        return [p for p in Path(place.removeprefix("file:")).rglob("*.parquet")]

    table = runtime.settle(spark.range(10))
    path = table._settled
    assert inside(path)
    runtime.release(table)
    assert not inside(path)
    before = runtime.cut(spark.range(5))
    place = Path(before._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert place.exists()
    runtime.release(before)
    assert not place.exists()
    runtime.release(None)


def test_walk_tells_when_it_has_not_settled(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node_id long")
    edges = spark.createDataFrame([(i, (i + 1) % 5, "calls") for i in range(5)] + [(5, 0, "calls")], "src long, dst long, kind string")
    for small in (0, pagerank.SMALL_EDGES):
        with warnings.catch_warnings(record=True) as told:
            warnings.simplefilter("always")
            pagerank.pagerank(nodes, edges, rounds=1, small_edges=small)
            assert any("last round" in str(w.message) for w in told)


def test_registry_and_memories(spark):
    rows = spark.createDataFrame([(1, "very_long_identifier " * 30), (2, "ab cd")], "node_id long, source string")
    registry = compress.ChunkRegistry(compress.dictionary_compress(rows))
    more = spark.createDataFrame([(2, "other_long_identifier " * 30)], "node_id long, source string")
    registry.register(compress.dictionary_compress(more))
    got = {r.node_id: r for r in registry.get(spark.createDataFrame([(1,), (2,), (9,)], "node_id long")).collect()}
    assert set(got) == {1, 2} and got[1].source == "very_long_identifier " * 30 and got[2].source == "other_long_identifier " * 30 and got[1].prompt.startswith("// aliases:")
    memories = spark.createDataFrame([("a", "x", 5), ("b", "y", 9), ("c", None, 9)], "id string, namespace string, last_accessed long")
    assert [r.id for r in memory.listing(memories).collect()] == ["b", "c", "a"] and [r.id for r in memory.listing(memories, "x", 3).collect()] == ["a"]


def test_model_adapter(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.v for r in rows.select("id", model_embedding(lambda: lambda texts: [[len(t), 1] for t in texts], 1)("text").alias("v")).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]}
    plain = {r.id: r.v for r in rows.select("id", model_embedding(lambda: None)("text").alias("v")).collect()}
    assert np.allclose(plain[1], feature_vector("ab")) and plain[2] is None


def test_syntax_graph(spark):
    text = "fn add(a: u8) -> u8 { helper(a) }\nfn helper(b: u8) -> u8 { b }\n"
    nodes, edges = build.syntax_graph(spark.createDataFrame([("a.rs", text), (None, "fn x() {}"), ("b.rs", None), ("c.rs", "")], "path string, text string"))
    rows = {r.node_id: r for r in nodes.collect()}
    kinds = [rows[i].kind for i in sorted(rows)]
    assert kinds[:3] == ["file", "fn", "fn"] and kinds.count("file") == 2
    helper = next(i for i, r in rows.items() if r.kind == "fn" and r.name == "helper")
    links = {(r.src, r.dst, r.kind) for r in edges.collect()}
    call = next(i for i, r in rows.items() if r.kind == "identifier" and r.name == "helper" and r.range_start < 34)
    assert (call, helper, "references") in links and (0, helper, "contains") in links
    assert all(rows[a].range_start <= rows[b].range_start and rows[b].range_end <= rows[a].range_end for a, b, k in links if k == "contains")


def test_engine_reindexes_limits_and_counts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("pub fn alpha() { beta() }\n")
    (tmp_path / "src/b.rs").write_text("pub fn beta() {}\n")
    engine = Engine.build(spark, str(tmp_path))
    before = engine.health()["merkle_root"]
    files = spark.createDataFrame([("src/b.rs", "pub fn beta() { gamma() }\npub fn gamma() {}\n")], "path string, text string")
    report = engine.reindex(files, ["src/b.rs", "src/gone.rs"])
    assert report["changed"] == 2 and report["skipped"] == 1 and report["merkle_root"] != before
    assert {r.name for r in engine.nodes.filter("kind = 'fn'").collect()} == {"alpha", "beta", "gamma"} and engine.stats()["edges_by_kind"]["calls"] == 2
    assert engine.similar_chunks("gamma", 1)[0]["id"].endswith("gamma")
    engine.settings.rate_burst = 1
    first = engine.search_request("gamma", 100.0, 3)
    assert first["hits"] and first["tokens"] == sum(h["tokens"] for h in first["hits"]) and engine.search_request("gamma", 100.0)["error"]
    told = engine.metrics(102.0)
    assert (told["requests"], told["limited"], told["searches"], told["requests_per_second"]) == (2, 1, 1, 1.0) and told["tokens"] == first["tokens"]
    events = engine.autocomplete("src/a.rs", 0, 10)
    assert [next(events)["event"], next(events)["event"]] == ["header", "surrounding"] and [e["event"] for e in events][-1] == "done"
    older, newer = engine.register("src/a.rs"), engine.register("src/a.rs")
    assert [e["event"] for e in engine.autocomplete("src/a.rs", 0, 10, older)] == ["header", "cancelled"]
    assert [e["event"] for e in engine.autocomplete("src/a.rs", 0, 10, newer)][-1] == "done" and [e["event"] for e in engine.autocomplete("nowhere", 0, 0)][-1] == "done"
    engine.save_memory("one", 5, "n")
    assert [m["namespace"] for m in engine.list_memories("n")] == ["n"] and engine.list_memories("other") == []
    answers = []
    engine.serve(['{"id": 1, "method": "ping"}', "  ", '{"id": 2, "method": "tools/call", "params": {"name": "list_memories"}}'], answers.append)
    assert [json.loads(a)["id"] for a in answers] == [1, 2] and all(a.endswith("\n") for a in answers)


def test_tree_of_one_and_of_none(spark):
    leaves = spark.createDataFrame([("a", "h")], "chunk_id string, hash string")
    assert merkle.merkle_root(leaves).first().root == "h" and merkle.merkle_root(leaves.limit(0)).count() == 0
