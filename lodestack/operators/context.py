"""From a cursor to a prompt: where it stands, what surrounds it, which dependencies fit the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, lines
from ..functions.tokens import token_estimate

BUDGET, DEPENDENCY_BUDGET, MOST_DEPENDENCIES, AROUND = 4000, 2400, 5, 16


def byte_offset(text: Column, line: Column, column: Column) -> Column:
    """Bytes before a place given by line and code point, both from 0 and clamped to the text."""
    def offset(rows: Column) -> Column:
        at = F.least(F.greatest(line, F.lit(0)), F.size(rows) - 1)
        before = F.aggregate(F.slice(rows, 1, at), F.lit(0), lambda total, row: total + F.octet_length(row) + 1)
        return before + F.octet_length(F.substring(F.get(rows, at), F.lit(1), F.greatest(column, F.lit(0))))

    return bind(F.split(text, "\n"), offset)


def node_at_cursor(nodes: DataFrame, cursors: DataFrame, width: int = 4096) -> DataFrame:
    """cursor_id, node_id: of the nodes of the cursor's file around its offset the narrowest, ties by node_id.

    Both ends count. Ranges are cut into buckets so that the join is on equal keys; ranges the wrong way
    round hold nothing. Cursors outside of all nodes give no row.
    """
    spans = nodes.filter("range_start <= range_end and node_id is not null").select("node_id", "file_path", "range_start", "range_end").distinct()
    spread = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("range_start") / width), F.floor(F.col("range_end") / width))))
    asked = cursors.select("cursor_id", "file_path", "offset", F.floor(F.col("offset") / width).alias("bucket"))
    inside = asked.join(spread, ["file_path", "bucket"]).filter("offset between range_start and range_end")
    return inside.groupBy("cursor_id").agg(F.min_by("node_id", F.struct(F.col("range_end") - F.col("range_start"), F.col("node_id"))).alias("node_id"))


def surrounding_lines(text: Column, line: Column, around: int = AROUND) -> Column:
    """Up to ``around`` lines before and behind the cursor's line, which is clamped to the text."""
    def near(rows: Column) -> Column:
        at = F.least(F.greatest(line, F.lit(0)), F.greatest(F.size(rows) - 1, F.lit(0)))
        first = F.greatest(at - around, F.lit(0))
        last = F.least(at + around, F.size(rows) - 1)
        return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(F.slice(rows, first + 1, F.greatest(last - first + 1, F.lit(0))), "\n"))

    return bind(lines(text), near)


def pack(ordered: Column, budget: int = DEPENDENCY_BUDGET, most: int = MOST_DEPENDENCIES) -> Column:
    """Of an ordered array of structs (text, tokens, ...) those that are taken.

    Equal texts are taken once, what doesn't fit is passed over, and at most ``most`` are taken. The array
    holds the candidates of one cursor, some tens at most.
    """
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"))
    numbered = F.transform(ordered, lambda d, i: F.struct(i.alias("i"), d["text"].alias("text"), d["tokens"].cast("long").alias("tokens")))
    def step(state: Column, d: Column) -> Column:
        known = F.exists(state["taken"], lambda t: F.get(ordered, t)["text"] == d["text"])
        fits = (state["used"] + d["tokens"] <= budget) & (F.size(state["taken"]) < most) & ~known
        return F.when(fits, F.struct((state["used"] + d["tokens"]).alias("used"), F.concat(state["taken"], F.array(d["i"])).alias("taken"))).otherwise(state)
    return F.transform(F.aggregate(numbered, empty, step)["taken"], lambda i: F.get(ordered, i))


def assemble(surrounding: Column, deps: Column, budget: int = BUDGET) -> Column:
    """The prompt: surrounding lines, then dependencies in order until the first that would pass the budget."""
    start = F.struct(token_estimate(surrounding).alias("used"), surrounding.alias("text"), F.lit(True).alias("open"), F.lit(0).alias("n"))
    def step(state: Column, d: Column) -> Column:
        fits = state["open"] & (state["used"] + d["tokens"] <= budget)
        text = F.concat(state["text"], F.lit("\n// dep "), (state["n"] + 1).cast("string"), F.lit("\n"), d["text"])
        return F.when(fits, F.struct((state["used"] + d["tokens"]).alias("used"), text.alias("text"), F.lit(True).alias("open"), (state["n"] + 1).alias("n"))).otherwise(F.struct(state["used"].alias("used"), state["text"].alias("text"), F.lit(False).alias("open"), state["n"].alias("n")))
    return F.aggregate(deps, start, step)["text"]


def snapshot(nodes: DataFrame, cursors: DataFrame) -> DataFrame:
    """cursor_id, node_id, name, pagerank of the node under each cursor."""
    found = node_at_cursor(nodes, cursors)
    names = nodes.select("node_id", "name", F.nanvl("pagerank", F.lit(None).cast("double")).alias("pagerank")).groupBy("node_id").agg(F.max(F.struct("pagerank", "name")).alias("row"))
    return found.join(names, "node_id", "left").select("cursor_id", "node_id", "row.name", "row.pagerank")
