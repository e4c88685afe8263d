"""From Rust files to chunks, graph nodes, edges, postings; and bridges between languages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rustscan import KEYWORDS, Scanner, walk
from ..runtime import cut, settle
from .graph import clean_edges, dense_ids

# Names of chunk kinds; those that name their content's scope.
CHUNK_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "type": "type", "const": "const", "static": "static", "macro": "macro", "mod": "module", "variant": "enum_variant", "union": "union"}
SCOPE_KINDS = frozenset(("module", "impl", "enum", "struct", "union"))
ITEM_KINDS = frozenset(("fn", "struct", "enum", "trait", "type", "const", "static", "macro", "impl", "mod"))

CHUNKS = "chunk_id string, file_path string, name string, kind string, source string, byte_start long, byte_end long, line_start long, line_end long, parent string, ord int"


def chunk_id(path: str, scope: list[str], kind: str, name: str) -> str:
    """File, scope, kind and name; scopes that are only digits count for kinds that make scopes."""
    kept = [s for s in scope if kind in SCOPE_KINDS or not (s.isascii() and s.isdigit())]
    return "::".join([path.replace("\\", "/"), *kept, kind, name])


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of every depth of each file (path, text), with content_hash; null paths or texts give none."""
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                ids: dict[int, str] = {}
                for number, (item, parents) in enumerate(walk(Scanner(text).items)):
                    kind = CHUNK_KINDS.get(item.kind)
                    if kind is None or item.kind == "mod" and item.body is None:
                        continue
                    up = [p for p in parents if p.kind in CHUNK_KINDS]
                    ids[id(item)] = own = chunk_id(path, [p.name for p in up], kind, item.name)
                    before, source = text[: item.start], text[item.start : item.end]
                    start = len(before.encode())
                    line = before.count("\n")
                    out.append((own, path, item.name, kind, source, start, start + len(source.encode()), line, line + source.count("\n") + 1, ids.get(id(up[-1])) if up else None, number))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    rows = files.select("path", "text").dropna().mapInPandas(cut_up, CHUNKS)
    return rows.withColumn("content_hash", F.sha2("source", 256))


def module_path(path: str) -> list[str]:
    """Modules of a file: folders and the file's stem, without mod, lib and main."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if parts and parts[-1] in ("mod.rs", "lib.rs", "main.rs"):
        return parts[:-1]
    if parts and parts[-1].endswith(".rs"):
        parts[-1] = parts[-1][:-3]
    return parts


ITEMS = "path string, ord int, tracker_id string, name string, kind string, source string, range_start long, range_end long, parent string, module array<string>, calls array<string>, types array<string>, implements string"


def _scan_file(path: str, text: str) -> list[tuple]:
    scanner = Scanner(text)
    out: list[tuple] = []
    taken: set[str] = set()

    def add(items, module: list[str], parent: str | None) -> None:
        for item in items:
            if item.kind not in ITEM_KINDS or item.kind == "mod" and item.body is None:
                continue
            base = f"{parent}::{item.kind}::{item.name}" if parent else "::".join(["crate", *module, item.kind, item.name])
            own, suffix = base, 2
            while item.kind == "impl" and own in taken:
                own, suffix = f"{base}::block::{suffix}", suffix + 1
            if own not in taken:
                taken.add(own)
                calls, types = scanner.calls_and_types(item)
                start = len(text[: item.start].encode())
                source = text[item.start : item.end]
                out.append((path, len(out), own, own.rsplit("::", 1)[-1], item.kind, source, start, start + len(source.encode()), parent, module, calls, types, item.trait))
            if item.kind == "impl":
                add(item.children, module, own)
            elif item.kind == "mod":
                add(item.children, [*module, item.name], own)

    add(scanner.items, module_path(path), None)
    return out


def items(files: DataFrame, root: str = "") -> DataFrame:
    """Graph items of each file with what they call, name and implement; ``root`` is the crate's source folder."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                inside = path[len(root) :].lstrip("/") if root and path.startswith(root.rstrip("/") + "/") else path
                out += [(path, *row[1:]) for row in _scan_file(inside, text)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ITEMS.split(", ")])

    return files.select("path", "text").dropna().mapInPandas(scan, ITEMS)


def normal_symbol(name: Column) -> Column:
    """Without generics, spaces and leading crate, self, super and std."""
    plain = F.trim(F.regexp_replace(name, "<.*$", ""))
    return F.regexp_replace(F.regexp_replace(plain, "^(crate::)*(self::)*(super::)*(std::)*", ""), r"\s+", "")


def build_graph(files: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a crate.

    Ids are dense in order of path and place. Of items with one tracker id the first stands. Names resolve
    in the own module, then in the modules around it, then anywhere, then by their last segment; of several
    bindings the first in order counts. Edges are distinct and never lead back to their node.
    """
    found = settle(items(files, root))
    first = Window.partitionBy("tracker_id").orderBy("path", "ord")
    unique = found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    nodes = settle(dense_ids(unique, ["path", "ord"]).withColumnRenamed("dense_id", "node_id"))
    ids = nodes.select("node_id", "tracker_id")

    last = F.element_at(F.split("tracker_id", "::"), -1)
    keys = F.array_distinct(F.array(last, F.concat_ws("::", F.concat("module", F.array(last)))))
    symbols = nodes.select("node_id", F.explode(keys).alias("key")).groupBy("key").agg(F.min("node_id").alias("target"))

    contains = nodes.select(F.col("node_id").alias("dst"), F.col("parent").alias("tracker_id")).join(ids, "tracker_id").select(F.col("node_id").alias("src"), "dst", F.lit("contains").alias("kind"))
    def wanted(names: Column, kind: str) -> DataFrame:
        return nodes.select("node_id", "module", F.explode(names).alias("name"), F.lit(kind).alias("kind"))
    asked = wanted(F.col("calls"), "calls").unionByName(wanted(F.col("types"), "references")).unionByName(wanted(F.filter(F.array("implements"), lambda x: x.isNotNull()), "implements"))
    asked = asked.withColumn("name", normal_symbol(F.col("name"))).filter("name <> ''").distinct()
    prefixes = F.transform(F.sequence(F.size("module"), F.lit(0), F.lit(-1)), lambda n: F.concat_ws("::", F.concat(F.slice("module", 1, n), F.array("name"))))
    tries = F.concat(prefixes, F.array(F.element_at(F.split("name", "::"), -1)))
    tried = asked.withColumn("tries", tries).select("node_id", "kind", "name", F.posexplode("tries").alias("priority", "key"))
    resolved = tried.join(symbols, "key").groupBy("node_id", "kind", "name").agg(F.min_by("target", "priority").alias("dst"))
    edges = clean_edges(contains.unionByName(resolved.select(F.col("node_id").alias("src"), "dst", "kind")))
    shown = nodes.select("node_id", "tracker_id", "name", "kind", "source", F.col("path").alias("file_path"), "range_start", "range_end")
    return shown, edges


SYNTAX = "path string, ord long, up long, kind string, name string, range_start long, range_end long, defines boolean"


def syntax_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of everything in each file: the file, its items at every depth, and every identifier.

    ``contains`` leads from the file or innermost item to what stands in it; ``references`` from an identifier
    to the first definition, in order of path and place, whose name it is. Ids are dense in that order. Null
    paths or texts give nothing; edges are distinct and never lead back to their node.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                scanner = Scanner(text)
                out.append((path, 0, None, "file", path, 0, len(text), False))
                number, own = 1, [(0, len(text), 0)]
                numbers: dict[int, int] = {}
                for item, parents in walk(scanner.items):
                    numbers[id(item)] = number
                    out.append((path, number, numbers[id(parents[-1])] if parents else 0, item.kind, item.name, item.start, item.end, True))
                    own.append((item.start, item.end, number))
                    number += 1
                own.sort(key=lambda x: (x[0], -x[1]))
                stack, at = [], 0
                for token in scanner.tokens:
                    while at < len(own) and own[at][0] <= token.start:
                        stack.append(own[at])
                        at += 1
                    while stack[-1][1] <= token.start and len(stack) > 1:
                        stack.pop()
                    if token.kind == "ident" and token.text not in KEYWORDS:
                        out.append((path, number, stack[-1][2], "identifier", token.text, token.start, token.end, False))
                        number += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SYNTAX.split(", ")]).astype({"up": "Int64"})

    found = settle(dense_ids(files.select("path", "text").dropna().dropDuplicates(["path"]).mapInPandas(scan, SYNTAX), ["path", "ord"]).withColumnRenamed("dense_id", "node_id"))
    upper = found.select("path", F.col("ord").alias("up"), F.col("node_id").alias("src"))
    contains = found.join(upper, ["path", "up"]).select("src", F.col("node_id").alias("dst"), F.lit("contains").alias("kind"))
    defined = found.filter("defines").groupBy("name").agg(F.min("node_id").alias("dst"))
    names = found.filter("kind = 'identifier'").join(defined, "name").select(F.col("node_id").alias("src"), "dst", F.lit("references").alias("kind"))
    return found.select("node_id", "path", "kind", "name", "range_start", "range_end"), clean_edges(contains.unionByName(names))


POSTINGS = "term string, node_id long, line long, weight double"


def postings(nodes: DataFrame) -> DataFrame:
    """term, node_id, line, weight of every identifier of each node's source, weighted by its role."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, text in zip(batch["node_id"], batch["source"]):
                scanner = Scanner(text)
                out += [(term, node, line, weight) for item in scanner.items for term, weight, line in scanner.weighted_names(item)]
            yield pd.DataFrame(out, columns=["term", "node_id", "line", "weight"])

    return nodes.select("node_id", "source").dropna().distinct().mapInPandas(scan, POSTINGS)


# --- bridges ------------------------------------------------------------------------------------------

# What marks a query or an endpoint in a source text, and a table in a query.
_SQL_CALL = r'(?i)(?:query!|query_as!)\s*\(\s*"([^"]*)"'
_SQL_RAW = r'(?i)r#?"((?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH)\s[^"]*)"'
_API = r'"((?:/api/|https?://[^"/\s]+/api/)[^"]*)"'
# Words that make a text SQL; path segments that name nothing.
_SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "WITH", "FROM", "WHERE")
_TABLE_WORDS = ("FROM", "JOIN", "INTO", "UPDATE")
_NO_RESOURCE = ("api", "v1", "v2", "v3", "get", "post", "put", "delete", "patch")


def bridges(nodes: DataFrame, id_column: str = "node_id", text_column: str = "source", api: str = _API) -> DataFrame:
    """node_id, type (sql or api), target of every query text and endpoint in a node's source, distinct."""
    text = F.col(text_column)
    sql = F.transform(F.concat(F.regexp_extract_all(text, F.lit(_SQL_CALL), 1), F.regexp_extract_all(text, F.lit(_SQL_RAW), 1)), lambda s: F.trim(s))
    sql = F.filter(sql, lambda s: (s != "") & F.exists(F.array(*(F.lit(w) for w in _SQL_WORDS)), lambda w: F.contains(F.upper(s), w)))
    found = F.concat(F.transform(sql, lambda s: F.struct(F.lit("sql").alias("type"), s.alias("target"))), F.transform(F.regexp_extract_all(text, F.lit(api), 1), lambda s: F.struct(F.lit("api").alias("type"), s.alias("target"))))
    return nodes.select(F.col(id_column).alias("node_id"), F.inline(found)).filter("node_id is not null").distinct()


def resources(type_: Column, target: Column) -> Column:
    """Tables of a query, or the naming segments of an endpoint; lower case, distinct."""
    tables = F.concat(*(F.regexp_extract_all(target, F.lit(rf"(?i){word}\s*([A-Za-z0-9_]+)"), 1) for word in _TABLE_WORDS))
    segments = F.filter(F.split(F.regexp_replace(target, r"[?#].*$", ""), "/"), lambda s: (s != "") & ~F.rlike(s, F.lit(r"^\d+$")) & ~F.lower(s).isin(*_NO_RESOURCE))
    return F.array_distinct(F.transform(F.when(type_ == "sql", tables).otherwise(segments), lambda s: F.lower(s)))


def _keyed(found: DataFrame) -> DataFrame:
    """key, node_id: the query texts, endpoints and resources that at least two nodes share."""
    exact = found.select("node_id", F.concat_ws(":", "type", "target").alias("key"))
    named = found.select("node_id", F.explode(resources(F.col("type"), F.col("target"))).alias("r")).select("node_id", F.concat(F.lit("resource:"), "r").alias("key"))
    keyed = cut(exact.unionByName(named).filter("node_id is not null").distinct())
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("nodes")).filter("nodes > 1"), "key")


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, class) of nodes with the same keys, and the (class, other) that share a key, a class also with itself."""
    signed = keyed.groupBy("node_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    classes = cut(signed.groupBy("keys").agg(F.min("node_id").alias("class")))
    members = cut(signed.join(classes, "keys").select("node_id", "class"))
    held = cut(classes.select("class", F.explode("keys").alias("key")))
    return members, held.join(held.withColumnRenamed("class", "other"), "key").select("class", "other").distinct()


def bridge_edges(found: DataFrame, hub: int | None = None) -> DataFrame:
    """Edges both ways between nodes that share a query text, an endpoint or a resource.

    Every ordered pair of the nodes of a key is linked, however many they are; nodes with the same keys are
    compared once. Callers who want fewer edges may name a ``hub``: nodes of a key that more than ``hub``
    share are then linked with the first node of the key only.
    """
    keyed = _keyed(found)
    if hub is None:
        members, linked = _classes(keyed)
        ends = linked.join(members.withColumnRenamed("node_id", "src"), "class")
        other = members.select(F.col("class").alias("other"), F.col("node_id").alias("dst"))
        return ends.join(other, "other").filter("src <> dst").select("src", "dst", F.lit("bridge").alias("kind"))
    first = keyed.groupBy("key").agg(F.min("node_id").alias("first"))
    few = keyed.filter(F.col("nodes") <= hub).select("key", "node_id")
    pairs = few.join(few.withColumnRenamed("node_id", "dst"), "key").select(F.col("node_id").alias("src"), "dst")
    star = keyed.filter(F.col("nodes") > hub).join(first, "key").select(F.col("first").alias("src"), F.col("node_id").alias("dst"))
    both = pairs.unionByName(star).unionByName(star.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter("src <> dst").distinct().withColumn("kind", F.lit("bridge"))


def bridge_count(found: DataFrame) -> DataFrame:
    """One row, edges: how many :func:`bridge_edges` gives, counted without making them."""
    members, linked = _classes(_keyed(found))
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    both = linked.join(sizes, "class").join(sizes.select(F.col("class").alias("other"), F.col("n").alias("m")), "other")
    edges = F.col("n") * (F.col("m") - F.when(F.col("class") == F.col("other"), 1).otherwise(0))
    return both.agg(F.coalesce(F.sum(edges), F.lit(0)).cast("long").alias("edges"))
