"""Merkle trees over chunk hashes, their difference, and the vector store that follows it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import clash_free, cut
from .graph import dense_ids

DEEP = 12  #: levels that are folded at once
BLOCK = 1 << DEEP


def _folder(base: int, more: bool):
    """A fold of one block of nodes of level ``base``: all nodes above them, up to the block's top.

    Neighbours are joined level by level, an odd last one is passed on. Where there are ``more`` blocks every
    block goes up by ``DEEP`` levels, so that the tops of all lie on one level.
    """
    def fold(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        hashes, first = block["hash"].tolist(), int(block["pos"].iat[0])
        out, level = [], base
        while len(hashes) > 1 or more and level < base + DEEP:
            pairs = [hashlib.sha256(len(a.encode()).to_bytes(8, "little") + a.encode() + b.encode()).hexdigest() for a, b in zip(hashes[::2], hashes[1::2])]
            hashes = pairs + hashes[len(hashes) - len(hashes) % 2 :]
            level, first = level + 1, first // 2
            out += [(level, first + i, h) for i, h in enumerate(hashes)]
        return pd.DataFrame(out, columns=["level", "pos", "hash"])

    return fold


def _folds(leaves: DataFrame) -> Iterator[DataFrame]:
    """level, pos, hash of the leaves (level 0), then of the nodes above them, ``DEEP`` levels at a time."""
    own = clash_free(leaves, "chunk_id", "hash").dropna().groupBy("chunk_id").agg(F.max("hash").alias("hash"))
    level = cut(dense_ids(own, ["chunk_id"]).select(F.lit(0).alias("level"), F.col("dense_id").alias("pos"), "hash"))
    base, count = 0, level.count()
    yield level
    while count > 1:
        more = count > BLOCK
        blocks = level.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).groupBy("block")
        folded = cut(blocks.applyInPandas(_folder(base, more), "level int, pos long, hash string"))
        yield folded
        base, count = base + DEEP, -(-count // BLOCK)
        level = folded.filter(F.col("level") == base)


def merkle_levels(leaves: DataFrame) -> DataFrame:
    """level, pos, hash of all nodes of the tree over (chunk_id, hash), leaves (level 0) ordered by chunk_id.

    Of a chunk with several hashes the largest counts; rows with nulls are left out. Blocks of leaves are
    folded where they lie, many levels at once; numbering is done by ranges, never in one task.
    """
    out = None
    for part in _folds(leaves):
        out = part if out is None else out.unionByName(part)
    return out


def merkle_root(leaves: DataFrame) -> DataFrame:
    """One row with root, or none for an empty tree."""
    top = list(_folds(leaves))[-1]
    return top.groupBy().agg(F.max_by("hash", "level").alias("root")).filter("root is not null")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id, change: ``changed`` (new or another hash) or ``deleted``; equal chunks are left out."""
    a = old.select("chunk_id", F.col("hash").alias("old_hash")).dropna(subset=["chunk_id"]).groupBy("chunk_id").agg(F.max("old_hash").alias("old_hash"), F.lit(True).alias("was"))
    b = new.select("chunk_id", F.col("hash").alias("new_hash")).dropna(subset=["chunk_id"]).groupBy("chunk_id").agg(F.max("new_hash").alias("new_hash"), F.lit(True).alias("is"))
    both = a.join(b, "chunk_id", "full_outer")
    change = F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull() | ~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    return both.select("chunk_id", change.alias("change")).filter("change is not null")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_alias(value: Column, key: str, prefix: str = "f_") -> Column:
    """A name that hides the value but is the same for equal values under one key."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit(key), value), 256))


def encrypt(text: Column, key: bytes) -> Column:
    """Hexadecimal AES-GCM with a fresh nonce before the body and the tag behind it."""
    return F.hex(F.aes_encrypt(text, F.unhex(F.lit(key.hex())), F.lit("GCM")))


def decrypt(sealed: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unhex(sealed), F.unhex(F.lit(key.hex())), F.lit("GCM")).cast("string")


def sync_chunks(chunks: DataFrame, synced: DataFrame, key: str) -> DataFrame:
    """chunk_id, content_hash, remote_id, action of each chunk: ``upsert`` when its hash is new, else ``skip``."""
    known = synced.select("chunk_id", F.col("content_hash").alias("known")).groupBy("chunk_id").agg(F.max("known").alias("known"))
    rows = chunks.select("chunk_id", "content_hash").dropna(subset=["chunk_id"]).dropDuplicates(["chunk_id"])
    action = F.when(F.col("known").eqNullSafe(F.col("content_hash")) & F.col("known").isNotNull(), "skip").otherwise("upsert")
    return rows.join(known, "chunk_id", "left").select("chunk_id", "content_hash", keyed_alias(F.col("chunk_id"), key, "c_").alias("remote_id"), action.alias("action"))


def latest_rows(store: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("updated_at", "arrived_at")) -> DataFrame:
    """The newest row of each key: an upsert of all rows in order of time."""
    rows = store.filter(F.col(key).isNotNull())
    rest = [c for c in store.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*").select(*store.columns)


def without_keys(store: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")
