"""Shorter prompts: dictionaries, aliases, signatures, diffs; sequential steps run in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from ..functions import linediff
from ..functions.rustscan import KEYWORDS, alias_identifiers, hidden_bodies, keep_methods, signatures, skeleton
from ..functions.text import evacuate_whitespace
from ..functions.tokens import token_estimate
from ..runtime import cut, release, settle, shuffle_width

_WORD = re.compile(r"\w+")
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def custom_identifiers(text: Column) -> Column:
    """Distinct names of more than three bytes that are no keywords, in order of appearance."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) > 3) & F.rlike(w, F.lit(r"^[\p{IsAlphabetic}_]")) & ~w.isin(*sorted(KEYWORDS))))


def short_token(number: int) -> str:
    """$a .. $z, $A .. $Z, $0 .. $9, $aa ..: signs counted without a zero."""
    out, number = "", number + 1
    while number:
        number, rest = divmod(number - 1, 62)
        out = _LETTERS[rest] + out
    return "$" + out


def _dictionary(source: str, names: list[str], first: int) -> tuple[str, dict[str, str]]:
    if re.search(r"\$[A-Za-z0-9]", source):
        return source, {}
    uses, short, table = Counter(_WORD.findall(source)), {}, {}
    for number, name in enumerate(names):
        token, size = short_token(first + number), len(name.encode())
        if uses[name] * (size - len(token)) > len(token) + size + 2:
            short[name], table[token] = token, name
    text = _WORD.sub(lambda m: short.get(m[0], m[0]), source)
    legend = f"// aliases:{','.join(f'{t}={n}' for t, n in sorted(table.items()))}\n" if table else ""
    return (text, table) if table and len((legend + text).encode()) < len(source.encode()) else (source, {})


def dictionary_compress(nodes: DataFrame, id_column: str = "node_id", text_column: str = "source") -> DataFrame:
    """node_id, compressed, dictionary, original_bytes, compressed_bytes of each node.

    Every node's names get running numbers over all nodes in order of id, whether used or not. The running
    sum is taken over ranges of ids, not in one task. Sources that hold ``$name`` already stay as they are,
    so that hydrating gives exactly the source. Of a node with several sources the greatest counts.
    """
    rows = nodes.select(F.col(id_column).alias("node_id"), F.col(text_column).alias("source")).dropna().groupBy("node_id").agg(F.max("source").alias("source"))
    ranged = cut(rows.repartitionByRange(shuffle_width(nodes.sparkSession), "node_id").withColumn("names", custom_identifiers(F.col("source"))).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum(F.size("names")).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum(F.size("names")).over(Window.partitionBy("part").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.join(F.broadcast(offsets), "part").withColumn("first", F.col("start") + within).select("node_id", "source", "names", "first")

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_dictionary(s, list(n), int(f)) for s, n, f in zip(batch["source"], batch["names"], batch["first"])]
            yield pd.DataFrame({
                "node_id": batch["node_id"], "compressed": [t for t, _ in done], "dictionary": [d for _, d in done],
                "original_bytes": [len(s.encode()) for s in batch["source"]], "compressed_bytes": [len(t.encode()) for t, _ in done],
            })

    return numbered.mapInPandas(shorten, "node_id long, compressed string, dictionary map<string,string>, original_bytes long, compressed_bytes long")


def legend(dictionary: Column) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(dictionary), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(dictionary) > 0, F.concat(F.lit("// aliases:"), F.array_join(pairs, ","), F.lit("\n"))).otherwise(F.lit(""))


def hydrate(text: Column, dictionary: Column) -> Column:
    """Tokens back to names, longest token first."""
    entries = F.array_sort(F.transform(F.map_entries(dictionary), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.aggregate(entries, text, lambda out, e: F.replace(out, e["key"], e["value"]))


class ChunkRegistry:
    """Compressed chunks by id: registered as one table, looked up and hydrated by joins."""

    def __init__(self, compressed: DataFrame) -> None:
        """``compressed``: what :func:`dictionary_compress` gives."""
        self.table = settle(compressed)

    def register(self, more: DataFrame) -> None:
        """Puts ``more`` in; of one node the newer row stands."""
        old = self.table
        kept = old.join(more.select("node_id").distinct(), "node_id", "left_anti").select(*old.columns)
        self.table = settle(kept.unionByName(more.select(*old.columns)))
        release(old)

    def get(self, ids: DataFrame) -> DataFrame:
        """node_id, prompt (legend and compressed text), source of the registered ones of ``ids``."""
        own = self.table.join(ids.select("node_id").distinct(), "node_id", "left_semi")
        return own.select("node_id", F.concat(legend(F.col("dictionary")), F.col("compressed")).alias("prompt"), hydrate(F.col("compressed"), F.col("dictionary")).alias("source"))


@F.pandas_udf(StringType())
def to_signatures(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: signatures(t) if isinstance(t, str) else None)


@F.pandas_udf(StringType())
def to_skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: skeleton(t) if isinstance(t, str) else None)


@F.pandas_udf(LongType())
def hidden_body_count(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(hidden_bodies(t)) if isinstance(t, str) else None)


@F.pandas_udf(StringType())
def aliased(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: alias_identifiers(t) if isinstance(t, str) else None)


@F.pandas_udf(StringType())
def only_methods(texts: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([keep_methods(t, set(n)) if isinstance(t, str) and n is not None else t for t, n in zip(texts, names)])


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([linediff.unified(a, b) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(old, new)])


@F.pandas_udf(StringType())
def apply_diff(text: pd.Series, diff: pd.Series) -> pd.Series:
    """The text with a diff applied, null where the diff doesn't fit."""
    def one(a, d):
        try:
            return linediff.apply(a, d)
        except (linediff.DiffError, TypeError, AttributeError):
            return None

    return pd.Series([one(a, d) for a, d in zip(text, diff)])


def diff_stats(diff: Column) -> Column:
    """Struct of hunks, added, removed, tokens, bytes."""
    rows = F.split(diff, "\n")
    count = lambda sign, head: F.size(F.filter(rows, lambda r: F.startswith(r, F.lit(sign)) & ~F.startswith(r, F.lit(head))))
    return F.struct(F.size(F.filter(rows, lambda r: F.startswith(r, F.lit("@@")))).alias("hunks"), count("+", "+++ ").alias("added"), count("-", "--- ").alias("removed"), token_estimate(diff).alias("tokens"), F.octet_length(diff).alias("bytes"))


def keeps_body(rank: Column, total: Column, threshold: float = 0.70, enabled: bool = True) -> Column:
    """Whether a dependency of this place (from 0) among so many keeps its bodies."""
    if not enabled:
        return F.lit(True)
    return (total == 0) | (1.0 - rank / total > threshold)


def prune_batch(deps: DataFrame, keys: tuple[str, ...] = (), threshold: float = 0.70) -> DataFrame:
    """deps (keys, id, score, text) with ``pruned`` and the text of the lower ranks cut to signatures.

    Ranks count within the keys, by score downwards, then by id; a single dependency is never cut.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    ranked = deps.withColumn("__rank", F.row_number().over(order) - 1).withColumn("__total", F.count("*").over(Window.partitionBy(*keys)))
    pruned = ~keeps_body(F.col("__rank"), F.col("__total"), threshold) & (F.col("__total") > 1)
    return ranked.withColumn("pruned", pruned).withColumn("text", F.when(F.col("pruned"), to_signatures("text")).otherwise(F.col("text"))).drop("__rank", "__total")


def postprocess(deps: DataFrame, reachable: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """deps (id, module_path, text, pruned) with text shortened, tokens and was_transformed; order by module_path.

    Pruned impl blocks keep only methods whose nodes are among ``reachable``, if given; then identifiers are
    aliased and white space goes. What is not pruned passes unchanged.
    """
    rows = deps
    if reachable is not None and nodes is not None:
        own = nodes.filter(F.col("kind") == "impl").select(F.col("node_id").alias("id"), F.col("tracker_id").alias("impl"))
        methods = nodes.join(reachable.select("node_id"), "node_id", "left_semi").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("tracker_id", "::")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("tracker_id", "::"), 1, n), "::"))).alias("impl"), "name")
        used = own.join(methods, "impl", "left").groupBy("id").agg(F.collect_set("name").alias("used"))
        rows = rows.join(used, "id", "left").withColumn("text", F.when(F.col("pruned") & F.col("used").isNotNull(), only_methods("text", "used")).otherwise(F.col("text"))).drop("used")
    short = evacuate_whitespace(aliased("text"))
    out = rows.withColumn("text", F.when(F.col("pruned"), short).otherwise(F.col("text")))
    return out.withColumn("tokens", token_estimate(F.col("text"))).withColumnRenamed("pruned", "was_transformed").orderBy("module_path")
