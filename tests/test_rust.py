import pytest
from pyspark.sql import functions as F

from lodestack.functions.rustscan import Scanner, alias_identifiers, alias_name, keep_methods, signatures, skeleton, walk
from lodestack.operators import build, compress
from lodestack.service import Engine
from lodestack.sources.files import Settings, Store, source_files

LIB = "pub mod math;\npub mod app;\n"
MATH = "".join(f"/// {n}\npub fn {n}(left: i64, right: i64) -> i64 {{\n    let result_value = left {op} right;\n    result_value\n}}\n\n" for n, op in (("add", "+"), ("subtract", "-"), ("multiply", "*"), ("divide", "/"), ("power", "^"), ("modulo", "%")))
APP = "use crate::math;\n\npub fn run() -> i64 {\n    let total = math::add(1, 2);\n    math::multiply(total, 3)\n}\n"


@pytest.fixture(scope="module")
def crate(tmp_path_factory):
    root = tmp_path_factory.mktemp("crate")
    (root / "src").mkdir()
    (root / "target").mkdir()
    for name, text in (("lib.rs", LIB), ("math.rs", MATH), ("app.rs", APP)):
        (root / "src" / name).write_text(text)
    (root / "target" / "gen.rs").write_text("fn skipped() {}")
    (root / "src" / "notes.txt").write_text("fn no() {}")
    return root


def test_scanner_kinds_and_nesting():
    source = "struct S { a: u8 }\nimpl Tr for S<'a> where S: X { fn f(&self) { fn inner() {} } }\nenum E { A, B(u8) }\nmacro_rules! m { () => { fn z() {} } }\nmod bare;\n"
    found = [(i.kind, i.name, len(p)) for i, p in walk(Scanner(source).items)]
    assert found == [("struct", "S", 0), ("impl", "Tr_for_S<'a>", 0), ("fn", "f", 1), ("fn", "inner", 2), ("enum", "E", 0), ("variant", "A", 1), ("variant", "B", 1), ("macro", "m", 0), ("mod", "bare", 0)]


@pytest.mark.parametrize("source", ["", "fn", "fn a(", "fn a() {", "}}}", '"open', "/* open", "r#\"open", "impl {", "struct", "'", "b'"])
def test_scanner_takes_broken_source(source):
    Scanner(source)
    signatures(source)
    skeleton(source)


def test_rewriting():
    source = "pub fn long_function_name(a: u8) -> u8 { long_value_here }\nstruct S { x: u8 }\n"
    assert signatures(source) == "pub fn long_function_name(a: u8) -> u8;\nstruct S { x: u8 }\n"
    assert signatures("// nothing") == "// nothing"
    both = "fn a() { 1 }\nfn b() { 2 }\n"
    at = both.index("{ 2 }")
    assert "{ 2 }" in skeleton(both, (at, at + 5)) and "{ 1 }" not in skeleton(both, (at, at + 5))
    repeated = 'fn f() { let repeated_identifier = "repeated_identifier"; ' + "use_it(repeated_identifier);" * 9 + " } // repeated_identifier"
    out = alias_identifiers(repeated)
    assert len(out) < len(repeated) and '"repeated_identifier"' in out and out.endswith("// repeated_identifier")
    assert alias_identifiers("fn f() {}") == "fn f() {}"
    assert [alias_name(i) for i in (0, 25, 26, 27)] == ["_a", "_z", "_aa", "_ab"]
    assert keep_methods("impl A { fn a() {} fn b() {} }", set()) == "impl A {}"
    assert [compress.short_token(i) for i in (0, 25, 26, 61, 62, 63, 3999)] == ["$a", "$z", "$A", "$9", "$aa", "$ab", "$abF"]


def test_graph_of_a_crate(spark):
    files = spark.createDataFrame([
        ("src/lib.rs", "mod server;\nfn main() { run(); }\npub fn run() { serve(); AppState::new(); }"),
        ("src/server/mod.rs", "pub fn serve(state: AppState) {}"),
        ("src/server/state.rs", "pub struct Database {}\npub struct AppState { db: Database }\nimpl AppState { pub fn new() -> AppState { make() } }"),
        ("src/server/empty.rs", ""),
        (None, "fn x() {}"), ("src/none.rs", None),
    ], "path string, text string")
    nodes, edges = build.build_graph(files, "src")
    names = {r.node_id: r.tracker_id for r in nodes.collect()}
    assert sorted(names) == list(range(len(names))) and len(names) == 7
    found = {(names[r.src].rsplit("::", 1)[-1], r.kind, names[r.dst].rsplit("::", 1)[-1]) for r in edges.collect()}
    assert found == {("main", "calls", "run"), ("run", "calls", "serve"), ("run", "calls", "new"), ("serve", "references", "AppState"), ("new", "references", "AppState"), ("AppState", "references", "Database"), ("for_AppState", "references", "AppState"), ("for_AppState", "contains", "new")}


def test_chunks_and_postings(spark):
    files = spark.createDataFrame([("a.rs", "fn outer() { fn inner() {} }\nstruct S;\nimpl S { fn m(&self) {} }")], "path string, text string")
    rows = {r.chunk_id: r for r in build.chunks(files).collect()}
    assert set(rows) == {"a.rs::function::outer", "a.rs::outer::function::inner", "a.rs::struct::S", "a.rs::impl::for_S", "a.rs::for_S::function::m"}
    inner = rows["a.rs::outer::function::inner"]
    assert inner.source == "fn inner() {}" and inner.parent == "a.rs::function::outer" and (inner.line_start, inner.line_end) == (0, 1)
    nodes = spark.createDataFrame([(1, "fn go(arg: Kind) {\n    helper(arg);\n    let x: Other = arg;\n}"), (2, None)], "node_id long, source string")
    got = {(r.term, r.line, r.weight) for r in build.postings(nodes).collect()}
    assert {("go", 0, 3.0), ("kind", 0, 3.0), ("arg", 0, 3.0), ("helper", 1, 1.0), ("other", 2, 2.0)} <= got


def test_bridges(spark):
    rows = [(1, 'sqlx::query!("SELECT id FROM users")'), (2, 'query!("UPDATE users SET x = 1")'), (3, 'fetch("/api/v1/orders/7")'), (4, '"https://h.example/api/orders"'), (5, 'query!("nothing here")'), (6, None)]
    found = build.bridges(spark.createDataFrame(rows, "node_id long, source string"))
    edges = {(r.src, r.dst) for r in build.bridge_edges(found).collect()}
    assert {(1, 2), (2, 1)} <= edges and not any(5 in e or 6 in e for e in edges)
    hub = spark.createDataFrame([(i, "api", "/api/things") for i in range(12)], "node_id long, type string, target string")
    assert build.bridge_edges(hub, hub=5).count() == 22


def test_bridges_of_a_hot_key_link_all_pairs(spark):
    hot = spark.range(1_002).selectExpr("id AS node_id", "'api' AS type", "concat('/api/things/', id) AS target")
    assert build.bridge_edges(hot).count() == 1_002 * 1_001 == build.bridge_count(hot).first().edges
    rows = [(i, "api", f"/api/{'abcde'[i % 5]}/{'xyz'[i % 3]}/{i // 7}") for i in range(40)] + [(i, "sql", "SELECT 1 FROM t") for i in range(0, 40, 9)] + [(99, "api", "/api/alone")]
    found = spark.createDataFrame(rows, "node_id long, type string, target string")
    edges = [(r.src, r.dst) for r in build.bridge_edges(found).collect()]
    keys = {}
    for r in found.select("node_id", "type", "target", build.resources(F.col("type"), F.col("target")).alias("names")).collect():
        keys.setdefault(r.node_id, set()).update([(r.type, r.target), *r.names])
    assert len(edges) == len(set(edges)) == build.bridge_count(found).first().edges
    assert set(edges) == {(a, b) for a in keys for b in keys if a != b and keys[a] & keys[b]}
    assert build.bridge_count(found.limit(0)).first().edges == 0


def test_dictionary_round_trip(spark):
    rows = spark.createDataFrame([(1, "very_long_identifier " * 30), (2, "ab cd"), (3, "$a " + "very_long_identifier " * 30), (4, None)], "node_id long, source string")
    done = {r.node_id: r for r in compress.dictionary_compress(rows).collect()}
    assert done[1].compressed_bytes < done[1].original_bytes and done[2].dictionary == {} and done[3].dictionary == {} and 4 not in done
    back = compress.dictionary_compress(rows).join(rows, "node_id").select((compress.hydrate(F.col("compressed"), F.col("dictionary")) == F.col("source")).alias("same"))
    assert all(r.same for r in back.collect())


def test_engine_end_to_end(spark, crate):
    assert {r.path for r in source_files(spark, str(crate)).collect()} == {"src/lib.rs", "src/math.rs", "src/app.rs"}
    engine = Engine.build(spark, str(crate))
    answer = engine.context("src/app.rs", 3, 17, "how is the add function implemented")
    assert "fn add" in answer["prompt"] and "fn multiply" in answer["prompt"] and answer["name"] == "run"
    raw = spark.createDataFrame([(LIB,), (MATH,), (APP,)], "t string").select(F.sum(F.ceil(F.octet_length("t") / 3.2))).first()[0]
    assert answer["tokens"] <= 0.7 * raw
    assert [e["event"] for e in engine.autocomplete("src/app.rs", 3, 17)][0] == "header"
    assert engine.search("") == [] and engine.health()["nodes"] == 7
    assert engine.stats()["edges_by_kind"]["calls"] == 2
    key = engine.save_memory("the add function adds", 1000, "math")
    assert engine.recall("add", 1000)[0]["id"] == key and engine.forget_memory(key) and engine.recall("add", 1000) == []
    import json

    assert "tools" in json.loads(engine.handle('{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}'))["result"]
    assert json.loads(engine.handle("{"))["error"]["code"] == -32700
    assert json.loads(engine.handle('{"id": 2, "method": "tools/call", "params": {"name": "list_files"}}'))["result"]
    assert json.loads(engine.handle('{"id": 3, "method": "tools/call", "params": {"name": "search_code", "arguments": {}}}'))["error"]["code"] == -32602


def test_settings_and_store(spark, tmp_path):
    config = Settings.load('{"rrf": {"weights": [2, 1, 1, 0.5]}, "context": {"max_dependencies": 3}, "unknown": 1}', {"LODESTACK_CONTEXT__BUDGET": "3000"})
    assert config.rrf.weights == [2, 1, 1, 0.5] and config.rrf.k == 60 and config.context.max_dependencies == 3 and config.context.surrounding_lines == 16 and config.context.budget == 3000
    store = Store(spark, str(tmp_path))
    assert store.load("x") is None
    for n in (3, 5):
        store.save("x", spark.range(n))
        assert store.load("x").count() == n
