"""Most similar vectors for every vector: small-world graphs per shard, shard results merged.

Plan: embeddings become unit float32 vectors; rows with the same vector share one representative, so
copies cost one search; a spherical k-means fitted on a bounded sample routes vectors to shards of
about ``shard_rows``; each shard builds one graph (see graphindex) over its own vectors. Graphs are kept as
a table of flat neighbour arrays that later queries search (:class:`GraphIndex`); when all vectors ask, a
shard answers its own and its guests' searches where its graph is built. A query's shard results are merged
by similarity.

Every vector is indexed once and searches the ``probes`` shards nearest to it. Recall of these settings
against brute force is in the README and in the tests; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import clash_free, settle
from .graphindex import Graph, Layer, build, search

SAMPLE_ROWS = 262_144  #: the most vectors that centroids are fitted on
ONE_LEVEL = 512  #: cells from which centroids are found by way of coarser ones
SHARD_ROWS = 1_024
PROBES, WIDTH = 7, 24
BAND = 3e-5  #: similarities this near to a bound are computed again from the full vectors
BAND_BROADCAST = 200_000  #: pairs in the band up to this number are broadcast (some 100 bytes each)
HOT_COPIES = 10_000  #: rows of one vector that go to one key of a join


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f4").reshape(-1, dims)


def _packed(unit: np.ndarray) -> list[bytes]:
    """Vectors for travelling as guests: a scale and two bytes for each number, which is exact to 2e-5 of the largest."""
    scale = np.maximum(np.abs(unit).max(1, initial=0), np.float32(1e-30)).astype("<f4")
    small = np.round(unit / scale[:, None] * 32_767).astype("<i2")
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, small)]


def _unpacked(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors of a column that holds full and packed ones."""
    out = np.empty((len(column), dims), np.float32)
    values = column.to_pylist()
    full = np.array([len(v) == 4 * dims for v in values], bool)
    out[full] = np.frombuffer(b"".join(v for v, f in zip(values, full) if f), "<f4").reshape(-1, dims)
    rest = np.frombuffer(b"".join(v for v, f in zip(values, full) if not f), np.uint8).reshape(-1, 4 + 2 * dims)
    scale = np.ascontiguousarray(rest[:, :4]).view("<f4")
    out[~full] = np.ascontiguousarray(rest[:, 4:]).view("<i2").astype(np.float32) / 32_767 * scale
    return out


def unit_vectors(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """``vector`` replaced by ``unit``: little-endian float32 bytes of length one, rounded to six places.

    Null where the vector is null, has another length than ``dims``, holds null, NaN or infinity, or is all zero.
    """
    schema = df.drop(vector).schema.add("unit", "binary")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(vector))
            lengths = np.asarray(lists.value_lengths().fill_null(-1))
            fits = lengths == dims
            flat = lists.filter(pa.array(fits)).flatten().cast(pa.float64())
            values = np.asarray(flat.fill_null(np.nan)).reshape(-1, dims)
            with np.errstate(all="ignore"):
                values = values / np.abs(values).max(axis=1, keepdims=True, initial=0)
                values = values / np.sqrt((values * values).sum(1, keepdims=True))
            values = np.round(values, 6).astype("<f4") + np.float32(0)
            sound = np.isfinite(values).all(1)
            out = np.full(len(lengths), None, object)
            out[np.flatnonzero(fits)[sound]] = [row.tobytes() for row in values[sound]]
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != vector]
            names = [name for name in batch.schema.names if name != vector]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], [*names, "unit"])

    return df.mapInArrow(convert, schema)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means over unit vectors; empty cells take the worst-fitting vectors."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(sample)))
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds if cells > 1 else 0):
        own, fit = np.empty(len(sample), np.int64), np.empty(len(sample), np.float32)
        for at in range(0, len(sample), 8_192):
            scores = sample[at : at + 8_192] @ centres.T
            own[at : at + 8_192], fit[at : at + 8_192] = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


@dataclass
class Cells:
    """Centroids of the shards, those of coarse cell i from ``begin[i]`` to ``begin[i + 1]``, and parts of each."""

    coarse: np.ndarray
    fine: np.ndarray
    begin: np.ndarray
    splits: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, count: int, shard_rows: int, one_level: int = ONE_LEVEL) -> Cells:
        """For ``count`` vectors, from a sample; there is at most one cell for each eight rows of the sample."""
        dims = sample.shape[1]
        wanted = max(1, min(-(-count // shard_rows), max(1, len(sample) // 8)))
        coarse = np.zeros((1, dims), np.float32) if wanted <= one_level else fit_centroids(sample, int(np.sqrt(wanted)))
        own = (sample @ coarse.T).argmax(1) if len(sample) else np.zeros(0, np.int64)
        parts = [fit_centroids(sample[own == i], max(1, round(wanted * (own == i).mean()))) if (own == i).any() else coarse[i : i + 1] for i in range(len(coarse))]
        fine = np.concatenate(parts)
        out = cls(coarse, fine, np.cumsum([0, *map(len, parts)]), np.ones(len(fine), np.int64), np.arange(len(fine) + 1))
        if len(sample):
            # a cell of more rows than three shards should have is cut into parts by a hash of the ids
            held = np.bincount(out.nearest(sample, 1)[:, 0], minlength=len(fine)) / len(sample) * count
            out.splits = np.maximum(1, np.ceil(held / (3 * shard_rows))).astype(np.int64)
            out.offsets = np.concatenate([[0], np.cumsum(out.splits)])
        return out

    def nearest(self, unit: np.ndarray, probes: int, reach: int = 8) -> np.ndarray:
        """The cells nearest to each vector, nearest first, looked for in its ``reach`` nearest coarse cells."""
        probes = min(probes, len(self.fine))
        if len(self.coarse) == 1:
            return _first(unit @ self.fine.T, probes)
        reach = min(max(reach, probes), len(self.coarse))
        tried = _first(unit @ self.coarse.T, reach)
        cell = np.zeros((len(unit), probes), np.int64)
        score = np.full((len(unit), probes), -np.inf, np.float32)
        for c in np.unique(tried):
            rows = np.flatnonzero((tried == c).any(1))
            lo, hi = self.begin[c], self.begin[c + 1]
            found = unit[rows] @ self.fine[lo:hi].T
            best = _first(found, min(probes, hi - lo))
            both = np.concatenate([score[rows], np.take_along_axis(found, best, 1)], 1)
            cells = np.concatenate([cell[rows], best + lo], 1)
            keep = _first(both, probes)
            score[rows], cell[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(cells, keep, 1)
        return cell


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, largest first; only these are sorted."""
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)


def _cells_of(rows: DataFrame, count: int, dims: int, shard_rows: int, sample_rows: int) -> Cells:
    """Fitted on the at most ``sample_rows`` rows of lowest hash."""
    sample = (rows.select(F.xxhash64("id").alias("h"), "unit").orderBy("h").limit(sample_rows) if count > sample_rows else rows).select("unit").toArrow()
    data = _matrix(sample["unit"], dims)
    return Cells.fit(data[np.lexsort(data.T[:3])], count, shard_rows)


def _route(df: DataFrame, cells, dims: int, probes: int, base: bool) -> DataFrame:
    """shard, base, id, unit: each row in its home shard (``base``), and where it is ``asked`` in those it searches."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells.value
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            unit = _matrix(table["unit"], dims)
            near = own.nearest(unit, probes)
            salt = pd.util.hash_array(np.asarray(table["id"].to_pandas(), object)) % np.uint64(1 << 31)
            home = own.offsets[near[:, 0]] + (salt % own.splits[near[:, 0]].astype(np.uint64)).astype(np.int64) if base else np.full(len(unit), -1)
            take, shard, is_base = ([np.arange(len(unit))], [home], [np.ones(len(unit), bool)]) if base else ([], [], [])
            for j in range(near.shape[1] if probes else 0):
                cell = near[:, j]
                for part in range(int(own.splits[cell].max(initial=1))):
                    at = own.offsets[cell] + part
                    guest = np.flatnonzero((part < own.splits[cell]) & (at != home))
                    take.append(guest)
                    shard.append(at[guest])
                    is_base.append(np.zeros(len(guest), bool))
            rows = np.concatenate(take)
            full = table["unit"].to_pylist()
            guests = _packed(unit) if base else full
            homes = len(unit) if base else 0
            vectors = [*full[:homes], *(guests[i] for i in rows[homes:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shard).astype(np.int32)), pa.array(np.concatenate(is_base)), table["id"].combine_chunks().take(pa.array(rows)), pa.array(vectors, pa.binary())],
                ["shard", "base", "id", "unit"],
            )

    return df.select("id", "unit").mapInArrow(route, "shard int, base boolean, id string, unit binary")


PAIRS = "id string, neighbour string, similarity double"


def _found(graph: Graph, ids: np.ndarray, asking: np.ndarray, unit: np.ndarray, k: int, width: int, floor: float) -> pa.Table:
    """PAIRS of the vectors ``unit`` named ``asking`` with the nodes ``ids`` of a graph, themselves left out."""
    found, score = search(graph, unit, k + 1, width=max(width, k + 1))
    good = (found >= 0) & (score >= floor)
    good[good] &= ids[found[good]] != np.repeat(asking, good.sum(1))
    r, c = np.nonzero(good)
    return pa.table({"id": pa.array(asking[r], pa.string()), "neighbour": pa.array(ids[found[r, c]], pa.string()), "similarity": pa.array(score[r, c].astype(np.float64))})


def _in_order(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) by id: rows arrive in another order in each run, and graphs must not depend on it."""
    ids = np.asarray(table["id"].to_pandas(), object)
    order = np.argsort(ids)
    return ids[order], _matrix(table["unit"], dims)[order]


def _best(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


GRAPH = "shard int, ids array<string>, vectors binary, layers array<struct<nodes: binary, links: binary>>"


@dataclass
class GraphIndex:
    """A table with one graph in flat arrays for each shard, and the cells by which queries find the shards."""

    graphs: DataFrame
    cells: Cells
    dims: int

    @classmethod
    def build(cls, vectors: DataFrame, dims: int = 64, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS, degree: int = 10) -> GraphIndex:
        """Of ``vectors`` (id, unit), ids distinct; the table is written once and read by every search."""
        cells = _cells_of(vectors, vectors.count(), dims, shard_rows, sample_rows)
        shared = vectors.sparkSession.sparkContext.broadcast(cells)

        def make(table: pa.Table) -> pa.Table:
            ids, unit = _in_order(table, dims)
            graph = build(unit, degree=degree)
            layers = [{"nodes": x.nodes.astype("<i4").tobytes(), "links": x.links.astype("<i4").tobytes()} for x in graph.layers]
            return pa.table({"shard": table["shard"][:1], "ids": pa.array([ids.tolist()], pa.list_(pa.string())), "vectors": pa.array([unit.tobytes()], pa.binary()), "layers": pa.array([layers], pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])))})

        return cls(settle(_route(vectors, shared, dims, 1, True).filter("base").groupBy("shard").applyInArrow(make, GRAPH)), cells, dims)

    def search(self, queries: DataFrame, k: int = 10, probes: int = PROBES, width: int = WIDTH, floor: float = -2.0) -> DataFrame:
        """id, neighbour, similarity, rank of the k nearest of each query (id, unit), itself left out by its id."""
        dims = self.dims
        shared = self.graphs.sparkSession.sparkContext.broadcast(self.cells)

        def answer(asked: pa.Table, graphs: pa.Table) -> pa.Table:
            if not graphs.num_rows or not asked.num_rows:
                return pa.table({"id": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
            row = graphs.to_pylist()[0]
            layers = [Layer(np.frombuffer(x["nodes"], "<i4").astype(np.int64), np.frombuffer(x["links"], "<i4").reshape(len(x["nodes"]) // 4, -1)) for x in row["layers"]]
            graph = Graph(np.frombuffer(row["vectors"], "<f4").reshape(-1, dims), layers)
            return _found(graph, np.array(row["ids"], object), np.asarray(asked["id"].to_pandas(), object), _matrix(asked["unit"], dims), k, width, floor)

        routed = _route(queries, shared, dims, probes, False).drop("base")
        return _best(routed.groupBy("shard").cogroup(self.graphs.groupBy("shard")).applyInArrow(answer, PAIRS), k)


def nearest(
    vectors: DataFrame,
    k: int = 10,
    dims: int = 64,
    min_similarity: float | None = None,
    queries: DataFrame | None = None,
    shard_rows: int = SHARD_ROWS,
    probes: int = PROBES,
    sample_rows: int = SAMPLE_ROWS,
    width: int = WIDTH,
    degree: int = 10,
    hot_copies: int = HOT_COPIES,
) -> DataFrame:
    """The k most similar others of each vector.

    ``vectors`` has id (string) and unit (from :func:`unit_vectors`); rows with a null in either are
    left out, of rows with one id the largest vector stands. ``queries``: ids to search for (all when
    None). Returns id, neighbour, similarity (cosine), rank (1 is nearest; ties by id). Pairs under
    ``min_similarity`` are left out after ranking. An empty input gives no rows.
    """
    rows = settle(clash_free(vectors, "id", "unit").dropna().groupBy("id").agg(F.max("unit").alias("unit")))
    same = F.struct(F.xxhash64("unit").alias("a"), F.xxhash64(F.lit(7), "unit").alias("b"))
    groups = settle(rows.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    floor = -2.0 if min_similarity is None else min_similarity
    if queries is None:
        pairs = _all_pairs(groups, k, dims, floor, shard_rows, probes, sample_rows, width, degree)
    else:
        asked = rows.join(clash_free(queries, "id").distinct(), "id", "left_semi").select("unit").distinct()
        index = GraphIndex.build(groups.select("id", "unit"), dims, shard_rows, sample_rows, degree)
        pairs = index.search(groups.join(asked, "unit", "left_semi").select("id", "unit"), k, probes, width, floor)
    several = settle(groups.filter("copies > 1").select(F.col("id").alias("rep"), same.alias("key"), F.ceil(F.col("copies") / hot_copies).cast("int").alias("salts")))
    if several.isEmpty():
        return pairs.select("id", "neighbour", "similarity", "rank")
    return _with_copies(rows.select("id", same.alias("key")), several, pairs, k, None if queries is None else clash_free(queries, "id").distinct())


def _all_pairs(groups: DataFrame, k: int, dims: int, floor: float, shard_rows: int, probes: int, sample_rows: int, width: int, degree: int) -> DataFrame:
    """Every vector asks: a shard builds its graph and answers its own vectors and its guests at once."""
    cells = groups.sparkSession.sparkContext.broadcast(_cells_of(groups, groups.count(), dims, shard_rows, sample_rows))

    def answer(table: pa.Table) -> pa.Table:
        ids, unit = _in_order(table.filter(table["base"]), dims)
        return _found(build(unit, degree=degree), ids, np.asarray(table["id"].to_pandas(), object), _unpacked(table["unit"], dims), k, width, floor - BAND)

    pairs = settle(_best(_route(groups, cells, dims, probes, True).groupBy("shard").applyInArrow(answer, PAIRS), k))
    near = pairs.filter(F.abs(F.col("similarity") - floor) < BAND)
    count = near.count()
    if not count:
        return pairs.filter(F.col("similarity") >= floor)
    near = F.broadcast(near) if count <= BAND_BROADCAST else near
    ends = groups.select("id", "unit")
    both = ends.join(near, "id").join(ends.select(F.col("id").alias("neighbour"), F.col("unit").alias("other")), "neighbour") if count > BAND_BROADCAST else ends.select(F.col("id").alias("neighbour"), F.col("unit").alias("other")).join(F.broadcast(settle(ends.join(near, "id"))), "neighbour")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(batch.schema.get_field_index(c)), dims).astype(np.float64) for c in ("unit", "other"))
            score = (a * b).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "neighbour")), pa.array(score), batch.column(batch.schema.get_field_index("rank"))], ["id", "neighbour", "similarity", "rank"])

    checked = both.select("id", "neighbour", "unit", "other", "rank").mapInArrow(exact, PAIRS + ", rank int").filter(F.col("similarity") >= floor)
    return pairs.filter(F.col("similarity") >= floor + BAND).select("id", "neighbour", "similarity", "rank").unionByName(checked)


def _with_copies(rows: DataFrame, several: DataFrame, pairs: DataFrame, k: int, queries: DataFrame | None) -> DataFrame:
    """From representatives to rows: the first k+1 ids of each group of copies stand for it in any top k.

    ``several``: the groups of more than one row. A group of very many rows is spread over ``salts`` keys:
    which groups are so is broadcast, at most one for each ``HOT_COPIES`` rows.
    """
    hot = F.broadcast(several.filter("salts > 1").select("key", "rep", "salts"))
    cold = several.filter("salts = 1").select("key", "rep", F.lit(1).alias("salts"))
    copied = settle(rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key")).select("rep", "id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")))
    first = Window.partitionBy("rep", "salt").orderBy("id")
    few = copied.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    head = few.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= k + 1)
    heads = settle(head.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("head")))
    wide = pairs.join(heads.withColumnRenamed("rep", "neighbour"), "neighbour", "left").select(
        F.col("id").alias("rep"), F.explode(F.coalesce("head", F.array("neighbour"))).alias("neighbour"), "similarity"
    )
    salted = several.select("rep", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = wide.join(salted, "rep", "left").select("rep", "neighbour", "similarity", F.coalesce("salt", F.lit(0)).alias("salt"))
    other = asked.join(copied, ["rep", "salt"], "left").select(F.coalesce("id", "rep").alias("id"), "neighbour", "similarity")
    spread = heads.join(salted, "rep").select("rep", "salt", "head")
    same = copied.join(spread, ["rep", "salt"]).select("id", F.explode("head").alias("neighbour"), F.lit(1.0).alias("similarity")).filter("id <> neighbour")
    both = other.unionByName(same)
    if queries is not None:
        both = both.join(queries, "id", "left_semi")
    return _best(both, k).select("id", "neighbour", "similarity", "rank")


def current_chunks(store: DataFrame, dims: int = 64) -> DataFrame:
    """id and unit of each chunk's current row: of those with a content_hash the one updated last.

    Ties go to the row that arrived last, then to the larger hash. A chunk whose current row has no
    usable embedding keeps a null unit. Rows without chunk_id or updated_at are left out.
    """
    rows = clash_free(store, "chunk_id", "embedding", "content_hash", "updated_at", "arrived_at")
    rows = rows.filter("chunk_id is not null and content_hash is not null and updated_at is not null")
    rows = unit_vectors(rows.select("chunk_id", "updated_at", "arrived_at", F.lower(F.trim("content_hash")).alias("hash"), "embedding"), "embedding", dims)
    return rows.groupBy(F.col("chunk_id").alias("id")).agg(F.max_by("unit", F.struct("updated_at", "arrived_at", "hash")).alias("unit"))


def similar_pairs(store: DataFrame, threshold: float = 0.92, k: int = 10, dims: int = 64, **settings) -> DataFrame:
    """chunk_a < chunk_b with cosine of ``threshold`` or more where one is among the k nearest of the other."""
    found = nearest(current_chunks(store, dims), k=k, dims=dims, min_similarity=threshold, **settings)
    return found.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
