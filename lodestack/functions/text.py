"""Text transforms as column expressions: lines, log compression, whitespace, symbol folding."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a log filter keeps; what forbids cutting a log short; commands whose output is filtered;
# commands that would wait for a terminal; escape sequences, progress bars and places in files; lengths of cut logs.
TEST_MARKERS = ("test result", "failures:", "FAILED", "failed", "error", "Error", "panic", "panicked", "assertion", "Caused by", "backtrace", "Tests:", "Suites:", "Time:", "running ", "Compiling", "warning:", "expected", "actual", "at ")
FAILURE_WORDS = ("error", "fail", "panic", "FAILED", "exception", "traceback", "✕", "×")
TEST_RUNNERS = ("cargo test", "jest", "pytest", "npm test", "yarn test", "go test", "mocha")
INTERACTIVE = ("vim", "vi", "nano", "emacs", "top", "htop", "ssh", "less", "more", "man")
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]|\x1b\][^\x07]*\x07|\x1b[()][AB0]"
PROGRESS = r"\[[=>.\s]*\]"
PATH_LINE = r"[A-Za-z0-9_./-]+:\d+"
TRUNCATE_ABOVE, TRUNCATE_KEEP = 50, 15

# Phrases that fold to one sign, by language.
_SCRIPT = ("import {", "import ", "export default ", "export async function ", "export function ", "export const ", "async function ", "function ", "const ", "return ", "from '", 'from "', "=>", "->", "::")
FOLD_PHRASES = {
    "rust": ("std::sync::Arc", "std::sync::Mutex", "std::sync::RwLock", "std::collections::HashMap", "std::collections::HashSet", "std::path::PathBuf", "pub async fn ", "pub fn ", "async fn ", "pub struct ", "pub enum ", "pub trait ", "impl ", "use std::", "use crate::", "return ", "self.", "fn ", "::", "->", "=>"),
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": ("from ", "import ", "async def ", "def ", "class ", "return ", "self.", "->", "=>"),
    "sql": ("SELECT ", "INSERT INTO ", "UPDATE ", "DELETE FROM ", "CREATE TABLE ", "ALTER TABLE ", "WHERE ", "GROUP BY ", "ORDER BY ", "LEFT JOIN ", "INNER JOIN ", "JOIN "),
}
# The signs of folded phrases, in order of use.
GLYPHS = "§ø∆¶æßðþŋħƿǽœƀđıȷɱɲɸʂʄʍʎ"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside of other functions an expression runs for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(column: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(column, F.lit(word))
    return found


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end makes no further line, an empty text has none."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\n\z", ""), "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def unlines(parts: Column) -> Column:
    """Lines with an end after each; empty for no lines."""
    return bind(parts, lambda rows: F.when(F.size(rows) == 0, F.lit("")).otherwise(F.concat(F.array_join(rows, "\n"), F.lit("\n"))))


def strip_ansi(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ANSI, ""), F.lit("\r"), F.lit(""))


def is_test_runner(command: Column) -> Column:
    return _any(command, TEST_RUNNERS)


def interactive_word(command: Column) -> Column:
    """The first word of a command line that would wait for a terminal; null if there is none."""
    return F.get(F.filter(F.split(command, r"[^A-Za-z0-9_./-]+"), lambda w: w.isin(*INTERACTIVE)), F.lit(0))


def filter_test_lines(parts: Column) -> Column:
    """Lines that tell something of a test run: marked or indented ones and places in files, no progress bars."""
    def keep(line: Column) -> Column:
        bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
        return ~F.rlike(line, F.lit(PROGRESS)) & (_any(bare, TEST_MARKERS) | F.rlike(bare, F.lit(PATH_LINE)) | F.startswith(line, F.lit(" ")) | F.startswith(line, F.lit("\t")))

    return F.filter(parts, keep)


def dedup_lines(parts: Column) -> Column:
    """Runs of equal lines as one line with `` (xN)`` behind it."""
    def runs(rows: Column) -> Column:
        numbers = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1)).otherwise(F.array().cast("array<int>"))
        return bind(F.filter(numbers, lambda i: (i == 0) | (F.get(rows, i) != F.get(rows, i - 1))), lambda starts: F.transform(starts, lambda start, at: shown(rows, starts, start, at)))

    def shown(rows: Column, starts: Column, start: Column, at: Column) -> Column:
        count = F.coalesce(F.get(starts, at + 1), F.size(rows)) - start
        return F.when(count > 1, F.concat(F.get(rows, start), F.lit(" (x"), count.cast("string"), F.lit(")"))).otherwise(F.get(rows, start))

    return bind(parts, runs)


def smart_truncate(parts: Column) -> Column:
    """Head and tail of long outputs in which no line tells of a failure."""
    return bind(parts, _head_and_tail)


def _head_and_tail(parts: Column) -> Column:
    count = F.size(parts)
    note = F.concat(F.lit("[... Truncated "), (count - 2 * TRUNCATE_KEEP).cast("string"), F.lit(" lines of token noise ...]"))
    short = F.concat(F.slice(parts, 1, TRUNCATE_KEEP), F.array(note), F.slice(parts, F.greatest(count - TRUNCATE_KEEP + 1, F.lit(1)), TRUNCATE_KEEP))
    return F.when((count <= TRUNCATE_ABOVE) | F.exists(parts, lambda line: _any(line, FAILURE_WORDS)), parts).otherwise(short)


def compress_output(text: Column, command: Column) -> Column:
    """A captured output with what a reader of its result doesn't need taken out."""
    plain = lines(strip_ansi(text))
    kept = F.when(is_test_runner(command), filter_test_lines(plain)).otherwise(plain)
    return unlines(smart_truncate(dedup_lines(kept)))


_BLANK = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def evacuate_whitespace(text: Column) -> Column:
    """Lines without blanks at both ends, one empty line for each run of empty ones, no final line end."""
    trimmed = F.transform(lines(text), lambda line: F.regexp_replace(line, f"^{_BLANK}+|{_BLANK}+$", ""))
    joined = F.regexp_replace(F.array_join(trimmed, "\n"), r"\n{3,}", "\n\n")
    joined = F.regexp_replace(joined, r"\A\n{2,}|\n{2,}\z", "\n")
    return bind(joined, lambda out: F.when(F.rlike(out, F.lit(r"\A\n*\z")), F.lit("")).otherwise(out))


def collapse_indent(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^[ \t]+", " ")


def language_of(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(ending.isin("ts", "tsx"), "typescript").when(ending.isin("js", "jsx", "mjs"), "javascript").when(ending == "py", "python").when(ending == "sql", "sql").otherwise("rust")


def fold_phrases(language: str) -> list[str]:
    """The phrases of a language, longest first; none for an unknown one."""
    return sorted(FOLD_PHRASES.get(language, ()), key=lambda p: -len(p.encode()))


def fold(text: Column, language: str) -> Column:
    """Struct of text and decoder (sign, phrase): each phrase that occurs becomes the next sign.

    A text that holds one of the signs already stays as it is, so unfolding is exact.
    """
    signs = F.array(*(F.lit(g) for g in GLYPHS))
    none = F.array().cast("array<struct<sign: string, phrase: string>>")
    phrases = F.array(*(F.lit(p) for p in fold_phrases(language))).cast("array<string>")

    def step(state: Column, phrase: Column) -> Column:
        sign = F.get(signs, F.size(state["decoder"]))
        folded = F.struct(F.replace(state["text"], phrase, sign).alias("text"), F.concat(state["decoder"], F.array(F.struct(sign.alias("sign"), phrase.alias("phrase")))).alias("decoder"))
        return F.when(F.contains(state["text"], phrase) & (F.size(state["decoder"]) < len(GLYPHS)), folded).otherwise(state)

    start = F.struct(text.alias("text"), none.alias("decoder"))
    return F.when(F.rlike(text, F.lit(f"[{GLYPHS}]")), start).otherwise(F.aggregate(phrases, start, step))


def unfold(folded: Column) -> Column:
    return F.aggregate(folded["decoder"], folded["text"], lambda out, e: F.replace(out, e["sign"], e["phrase"]))


#: Fixed value: how the line begins that tells what folded signs stand for.
LEGEND = "// token-fold decoder: "


def fold_legend(folded: Column) -> Column:
    """The line before a folded text that tells what its signs stand for; empty if it has none."""
    shown = F.array_join(F.transform(folded["decoder"], lambda e: F.concat(e["sign"], F.lit("="), e["phrase"])), ",")
    return F.when(F.size(folded["decoder"]) == 0, F.lit("")).otherwise(F.concat(F.lit(LEGEND), shown, F.lit("\n")))


def contained_path(root: str, path: str) -> str | None:
    """``path`` under ``root`` as a real path, or None when it leads out of it."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path))
    return full if full == base or full.startswith(base + os.sep) else None
