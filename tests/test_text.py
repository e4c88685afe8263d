import pytest
from pyspark.sql import functions as F

from lodestack.functions import linediff
from lodestack.functions import text as T
from lodestack.functions.tokens import query_terms, token_estimate
from lodestack.plans import texts


def one(spark, expression, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], kinds).select(expression(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize("text,want", [("", 0), ("12345", 2), ("a", 1), ("{}{}{}{}{}", 4), (None, None), ("é" * 10, 7), (",;" * 30, 20)])
def test_token_estimate(spark, text, want):
    assert one(spark, token_estimate, text) == want


def test_query_terms(spark):
    assert one(spark, query_terms, "AutocompleteRequest search_engine") == ["autocomplete", "request", "search", "engine"]
    assert one(spark, query_terms, "  ") == []


@pytest.mark.parametrize("text,want", [("a\nb\n", ["a", "b"]), ("", []), ("\n", [""]), ("a\r\nb", ["a", "b"]), ("a", ["a"]), (None, None)])
def test_lines(spark, text, want):
    assert one(spark, T.lines, text) == want


@pytest.mark.parametrize("text,want", [("  a  \n\n\n\tb\n", "a\n\nb"), ("\n\n a", "\na"), ("a\n\n", "a\n"), ("\n\n", ""), ("", "")])
def test_evacuate_whitespace(spark, text, want):
    assert one(spark, T.evacuate_whitespace, text) == want


def test_dedup_and_truncate(spark):
    assert one(spark, lambda c: T.unlines(T.dedup_lines(T.lines(c))), "x\nx\nx\nx\ny\n") == "x (x4)\ny\n"
    many = "\n".join(f"line {i}" for i in range(80))
    out = one(spark, lambda c: T.unlines(T.smart_truncate(T.lines(c))), many)
    assert "Truncated 50 lines" in out and out.count("\n") == 31
    failing = many + "\nerror: no"
    assert one(spark, lambda c: T.unlines(T.smart_truncate(T.lines(c))), failing) == failing + "\n"


def test_log_of_a_test_run_shrinks(spark):
    log = "\x1b[32mrunning 30 tests\x1b[0m\n" + "".join(f"test case_{i} ... ok\n" for i in range(30)) + "[====>   ]\ntest result: ok. 30 passed\n"
    out = one(spark, T.compress_output, log, "cargo test --all")
    assert out == "running 30 tests\ntest result: ok. 30 passed\n"
    assert one(spark, lambda t: token_estimate(t), out) <= 0.6 * one(spark, lambda t: token_estimate(t), log)
    assert one(spark, T.strip_ansi, "\x1b[1;31mred\x1b[0m\r\n") == "red\n"


def test_fold_round_trip_and_collision(spark):
    code = "pub fn a() -> u8 { self.x::y() }"
    folded = one(spark, lambda c: T.fold(c, "rust"), code)
    assert folded.text == "§a() ¶ u8 { øx∆y() }" and [e.phrase for e in folded.decoder] == ["pub fn ", "self.", "::", "->"]
    assert one(spark, lambda c: T.unfold(T.fold(c, "rust")), code) == code
    assert one(spark, lambda c: T.fold(c, "rust"), "ß pub fn a").text == "ß pub fn a"
    assert one(spark, lambda c: T.fold_legend(T.fold(c, "rust")), code) == "// token-fold decoder: §=pub fn ,ø=self.,∆=::,¶=->\n"
    assert one(spark, lambda c: T.fold_legend(T.fold(c, "cobol")), code) == ""


def test_indent_language_interactive(spark):
    assert one(spark, T.collapse_indent, "a\n    b\n\tc") == "a\n b\n c"
    assert one(spark, T.language_of, "x/y.TSX") == "typescript" and one(spark, T.language_of, "Makefile") == "rust"
    assert one(spark, T.interactive_word, "git log | less") == "less" and one(spark, T.interactive_word, "cargo build") is None
    assert T.contained_path("/tmp", "../etc/passwd") is None and T.contained_path("/tmp", "a") is not None


def test_diffs():
    old, new = "a\nb\nc\nd\ne\nf\ng\n", "a\nB\nc\nd\ne\nf\nh\n"
    diff = linediff.unified(old, new, 1)
    assert linediff.apply(old, diff) == new and diff.count("@@ -") == 2
    assert linediff.unified(old, old) == "" and linediff.apply("", linediff.unified("", "x")) == "x"
    assert linediff.unified(old, new, 3).count("@@ -") == 1
    with pytest.raises(linediff.DiffError):
        linediff.apply("z\n", diff)
    with pytest.raises(linediff.DiffError):
        linediff.apply("a\n", "nonsense")


def test_log_compression_takes_all_documents(spark, tmp_path):
    rows = [(1, "test a ... ok\n", "terminal_log", "a"), (2, "test b ... ok\n", None, "b"), (3, "plain\n", "web", "c"), (4, None, "web", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, path string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.before for r in texts.log_compressed(spark, str(tmp_path)).collect()}
    assert found == {1: 14, 2: 14, 3: 6, 4: None}
