"""The engine behind one object: search, context, graph, memories and statistics, and their JSON messages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import contained_path
from .functions.tokens import token_estimate
from .functions.vectors import fallback_embedding
from .operators import build, compress, context, fusion, graph, memory, pagerank
from .operators.indexing import CHUNK, ChunkIndex
from .runtime import release, settle
from .sources.files import Settings, listing, normal, source_files
from .streaming import changes

MEMORY = "id string, content string, namespace string, created_at long, last_accessed long, access_count long, importance double"


@dataclass
class Engine:
    """All tables of one source tree. ``build`` makes them; every request reads them."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    postings: DataFrame
    vectors: DataFrame
    membership: DataFrame
    files: DataFrame
    chunks: DataFrame
    settings: Settings = field(default_factory=Settings)
    memories: DataFrame | None = None
    sequence: int = 0
    moves: DataFrame | None = None
    index: ChunkIndex | None = None
    crate: str = "src"
    counts: dict[str, int] = field(default_factory=lambda: {"requests": 0, "searches": 0, "limited": 0, "tokens": 0})
    started: float | None = None
    bucket: tuple[float, float | None] | None = None
    requests: dict[str, int] = field(default_factory=dict)

    @classmethod
    def build(cls, spark: SparkSession, root: str, settings: Settings | None = None, files: DataFrame | None = None, crate: str = "src") -> Engine:
        files = settle(files if files is not None else source_files(spark, root))
        settings = settings or Settings()
        index = ChunkIndex.build(build.chunks(files).select(*CHUNK), settings.alias_key)
        return cls._of(spark, files, index, settings, crate, spark.createDataFrame([], MEMORY))

    @classmethod
    def _of(cls, spark: SparkSession, files: DataFrame, index: ChunkIndex, settings: Settings, crate: str, memories: DataFrame) -> Engine:
        """All tables that follow from the files; chunks and what belongs to them come in ``index``."""
        nodes, edges = build.build_graph(files, crate)
        linked = settle(edges.unionByName(build.bridge_edges(build.bridges(nodes))).distinct())
        scores = pagerank.pagerank(nodes, linked)
        nodes = settle(nodes.join(scores.withColumnRenamed("score", "pagerank"), "node_id"))
        search = fusion.SearchIndex.build(nodes, linked, fallback_embedding)
        return cls(spark, nodes, linked, settle(build.postings(graph.searchable(nodes))), search.vectors, search.membership, files, index.chunks, settings, memories, moves=search.moves, index=index, crate=crate)

    def reindex(self, files: DataFrame, paths: list[str]) -> dict:
        """Take over the files of ``paths`` as ``files`` (path, text) has them now; the report of the update.

        Tree, trigram index and sent hashes change by the chunks that differ; graph, postings, vectors and
        communities are made again from the updated files.
        """
        changed = self.spark.createDataFrame([(normal(p),) for p in paths], "path string")
        fresh = files.select("path", "text").join(changed, "path", "left_semi")
        after = settle(self.files.select("path", "text").join(changed, "path", "left_anti").unionByName(fresh).withColumn("ext", F.element_at(F.split("path", r"\."), -1)))
        index, report = self.index.update(build.chunks(fresh).select(*CHUNK), changed)
        new = self._of(self.spark, after, index, self.settings, self.crate, self.memories)
        for name in ("nodes", "edges", "postings", "vectors", "membership", "files", "chunks", "moves", "index"):
            old = getattr(self, name)
            setattr(self, name, getattr(new, name))
            if name != "index" and old is not getattr(new, name):
                release(old)
        return report

    # --- search and context ---------------------------------------------------------------------

    def allow(self, now: float) -> bool:
        """Whether a request at ``now`` (seconds) may pass the rate limit."""
        config = self.settings
        tokens, last = self.bucket or (max(config.rate_burst, 1.0), None)
        allowed, tokens, last = changes.take(now, tokens, last, config.rate_burst, config.rate_refill)
        self.bucket = tokens, last
        self.started = now if self.started is None else self.started
        self.counts["requests"] += 1
        self.counts["limited"] += not allowed
        return allowed

    def search_request(self, query: str, now: float, top_k: int = 10, node: int | None = None) -> dict:
        """A search under the rate limit: hits with path and tokens, and the tokens of all of them."""
        if not self.allow(now):
            return {"error": "rate limit exceeded", "hits": []}
        hits = self.search(query, top_k, node)
        found = self.spark.createDataFrame([(h["node_id"],) for h in hits], "node_id long")
        rows = {r["node_id"]: r for r in self.nodes.join(found, "node_id").select("node_id", "file_path", "pagerank", token_estimate(F.col("source")).alias("tokens")).collect()}
        hits = [h | {"file_path": rows[h["node_id"]]["file_path"], "pagerank": rows[h["node_id"]]["pagerank"], "tokens": rows[h["node_id"]]["tokens"] or 0} for h in hits]
        total = sum(h["tokens"] for h in hits)
        self.counts["searches"] += 1
        self.counts["tokens"] += total
        return {"hits": hits, "tokens": total}

    def search(self, query: str, top_k: int = 10, node: int | None = None) -> list[dict]:
        k = min(max(top_k, 1), 100)
        config = self.settings
        weights = fusion.FusionSettings(config.rrf.k, config.rrf.score_alpha, config.rrf.weights)
        found = fusion.hybrid_search(self.nodes, self.edges, self.postings, self.vectors, self.membership, query, fallback_embedding, k, node, k * config.search.candidate_multiplier, weights, graph.dependency_scores(self.nodes, self.edges), moves=self.moves)
        return [r.asDict(recursive=True) for r in found.orderBy("position").collect()]

    def _place(self, path: str, line: int, column: int) -> dict | None:
        """What stands around a cursor: lines, and the node with its name; None for an unknown path."""
        file = self.files.filter(F.col("path") == path)
        at = file.select(F.lit(0).alias("cursor_id"), F.col("path").alias("file_path"), context.byte_offset(F.col("text"), F.lit(line), F.lit(column)).alias("offset"), context.surrounding_lines(F.col("text"), F.lit(line), self.settings.context.surrounding_lines).alias("around"))
        place = at.first()
        if place is None:
            return None
        cursor = context.node_at_cursor(self.nodes, at).first()
        node = cursor["node_id"] if cursor else None
        return {"around": place["around"], "node": node, "name": self.nodes.filter(F.col("node_id") == node).first()["name"] if node is not None else ""}

    def _dependencies(self, place: dict, query: str) -> list[dict]:
        """The packed dependencies of a cursor's place, in order."""
        config, node = self.settings.context, place["node"]
        hits = self.search(query or place["name"] or "main", max(config.max_dependencies * 4, 10), node)
        kept = [h for h in hits if h["node_id"] != node][: config.max_dependencies]
        if not kept:
            return []
        scored = self.spark.createDataFrame([(h["node_id"], float(h["fused"])) for h in kept], "id long, score double")
        texts = scored.join(self.nodes.select(F.col("node_id").alias("id"), F.col("tracker_id").alias("module_path"), F.col("source").alias("text")), "id")
        pruned = compress.prune_batch(texts, threshold=config.keep_threshold)
        start = self.spark.createDataFrame([(node,)], "node_id long") if node is not None else None
        reach = graph.reachable(self.edges, start) if start is not None else None
        done = compress.postprocess(pruned, reach, self.nodes if reach is not None else None)
        ordered = done.agg(F.sort_array(F.collect_list(F.struct("module_path", "text", "tokens"))).alias("deps"))
        packed = ordered.select(context.pack(F.col("deps"), config.dependency_budget, config.max_dependencies).alias("deps")).first()
        return [d.asDict() for d in packed["deps"]]

    def _prompt(self, place: dict, deps: list[dict]) -> dict:
        rows = self.spark.createDataFrame([(place["around"], [(d["module_path"], d["text"], d["tokens"]) for d in deps])], "around string, deps array<struct<module_path: string, text: string, tokens: bigint>>")
        prompt = rows.select(context.assemble(F.col("around"), F.col("deps"), self.settings.context.budget).alias("p")).select("p", token_estimate(F.col("p")).alias("t")).first()
        return {"prompt": prompt["p"], "tokens": prompt["t"]}

    def context(self, path: str, line: int, column: int, query: str = "") -> dict:
        """The prompt for a cursor with its sizes; an unknown path gives an empty one."""
        place = self._place(path, line, column)
        if place is None:
            return {"prompt": "", "tokens": 0, "dependencies": []}
        deps = self._dependencies(place, query)
        return self._prompt(place, deps) | {"dependencies": deps, "node_id": place["node"], "name": place["name"]}

    def register(self, path: str) -> int:
        """The number of a new request for a file; older requests for it end at their next event."""
        self.requests[path] = self.requests.get(path, 0) + 1
        return self.requests[path]

    def autocomplete(self, path: str, line: int, column: int, request: int | None = None) -> Iterator[dict]:
        """Events, each given out as soon as it is known: header, surroundings, each dependency, one final event.

        ``request``: the number from :meth:`register`; when a newer one was given for the file, the events end
        with ``cancelled``.
        """
        def late() -> bool:
            return request is not None and self.requests.get(path) != request

        place = {"around": "", "node": None, "name": ""} if late() else self._place(path, line, column) or {"around": "", "node": None, "name": ""}
        yield {"event": "header", "file": path, "node": place["name"]}
        if not late():
            yield {"event": "surrounding", "text": place["around"]}
        deps = [] if late() or not place["around"] else self._dependencies(place, "")
        for number, dep in enumerate(deps, 1):
            if late():
                break
            yield {"event": "dependency", "number": number, **dep}
        yield {"event": "cancelled"} if late() else {"event": "done", "tokens": self._prompt(place, deps)["tokens"]}

    # --- statistics -----------------------------------------------------------------------------

    def health(self) -> dict:
        return {"nodes": self.nodes.count(), "edges": self.edges.count(), "memories": self.memories.count(), "merkle_root": self.index.root}

    def metrics(self, now: float) -> dict:
        """Counters since the first request, requests a second, and how far sources shrink."""
        seconds = max(now - self.started, 1e-9) if self.started is not None else 0.0
        return self.counts | {"requests_per_second": self.counts["requests"] / seconds if seconds else 0.0, "compression_ratio": self.stats()["compression_ratio"]}

    def similar_chunks(self, text: str, k: int = 10) -> list[dict]:
        return [r.asDict() for r in self.index.search(text, k).collect()]

    def stats(self) -> dict:
        kinds = {r["kind"]: r["edges"] for r in graph.edge_kind_stats(self.edges).collect()}
        sizes = compress.dictionary_compress(self.nodes).agg(F.sum("original_bytes").alias("o"), F.sum("compressed_bytes").alias("c")).first()
        before, after = sizes["o"] or 0, sizes["c"] or 0
        return {"edges_by_kind": kinds, "original_bytes": before, "compressed_bytes": after, "bytes_saved": before - after, "compression_ratio": after / before if before else 1.0}

    def neighbourhood(self, node_id: int) -> dict | None:
        own = self.nodes.filter(F.col("node_id") == node_id).select("node_id", "name", "kind", "pagerank").first()
        if own is None:
            return None
        rows = graph.neighbourhood(self.nodes, self.edges, node_id).collect()
        return own.asDict() | {d: [r.asDict() for r in rows if r["direction"] == d] for d in ("in", "out")}

    def list_files(self) -> list[dict]:
        return [r.asDict() for r in listing(self.nodes).orderBy("file_path").collect()]

    # --- memories -------------------------------------------------------------------------------

    def save_memory(self, content: str, now: int, namespace: str | None = None, importance: float | None = None) -> str:
        self.sequence += 1
        id_ = f"mem_{now * 1000}_{self.sequence}"
        row = self.spark.createDataFrame([(id_, content, namespace, now, now, 0, importance)], MEMORY)
        self._keep(memory.save(self.memories, row.withColumn("importance", memory.importance(F.col("importance"), F.col("content"), F.col("namespace")))))
        return id_

    def recall(self, query: str, now: int, k: int = 10) -> list[dict]:
        found = memory.recall(self.memories, query, now, k)
        return [r.asDict() for r in found.join(self.memories.select("id", "content", "namespace"), "id").orderBy(F.desc("score"), "id").collect()]

    def list_memories(self, namespace: str | None = None, k: int | None = None) -> list[dict]:
        return [r.asDict() for r in memory.listing(self.memories, namespace, k).collect()]

    def _keep(self, memories: DataFrame) -> None:
        """The memories as a new table; the files of the older one go."""
        old, self.memories = self.memories, settle(memories)
        release(old)

    def forget_memory(self, id_: str) -> bool:
        before = self.memories.count()
        self._keep(memory.forget(self.memories, self.spark.createDataFrame([(id_,)], "id string")))
        return self.memories.count() < before

    def update_memory(self, id_: str, importance: float | None = None, namespace: str | None = None) -> None:
        self._keep(memory.update(self.memories, id_, importance, namespace))

    def prune_memories(self, now: int) -> None:
        self._keep(memory.prune(self.memories, now))

    # --- messages -------------------------------------------------------------------------------

    def serve(self, lines: Iterable[str], write: Callable[[str], None]) -> None:
        """Answers each line with a line until there are no more; blank lines are passed over."""
        for line in lines:
            if line.strip():
                write(self.handle(line) + "\n")

    def handle(self, message: str) -> str:
        """One JSON-RPC request to one reply: tools/list, tools/call and ping."""
        try:
            request = json.loads(message)
        except ValueError:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}})
        # The names of the tools.
        tools = {
            "search_code": lambda a: self.search(a["query"], int(a.get("top_k", 10))),
            "get_context": lambda a: self.context(a["file"], int(a.get("line", 0)), int(a.get("column", 0)), a.get("query", "")),
            "save_memory": lambda a: self.save_memory(a["content"], int(a["now"]), a.get("namespace"), a.get("importance")),
            "recall": lambda a: self.recall(a["query"], int(a["now"]), int(a.get("limit", 10))),
            "list_memories": lambda a: self.list_memories(a.get("namespace"), a.get("limit")),
            "forget_memory": lambda a: self.forget_memory(a["id"]),
            "update_memory": lambda a: self.update_memory(a["id"], a.get("importance"), a.get("namespace")),
            "health": lambda a: self.health(),
            "list_files": lambda a: self.list_files(),
        }
        reply: dict = {"jsonrpc": "2.0", "id": request.get("id")}
        params = request.get("params") or {}
        if request.get("method") == "ping":
            reply["result"] = {}
        elif request.get("method") == "tools/list":
            reply["result"] = {"tools": [{"name": name} for name in tools]}
        elif request.get("method") == "tools/call" and params.get("name") in tools:
            try:
                reply["result"] = tools[params["name"]](params.get("arguments") or {})
            except (KeyError, TypeError, ValueError) as problem:
                reply["error"] = {"code": -32602, "message": f"invalid arguments: {problem}"}
        else:
            reply["error"] = {"code": -32601, "message": "no such method"}
        return json.dumps(reply, default=str)

    @staticmethod
    def resolve(root: str, path: str) -> str | None:
        return contained_path(root, path)
