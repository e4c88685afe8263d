"""The index of chunks as one thing: chunks, trigram index, sizes, sent hashes and tree root, built and updated together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import release, settle
from ..sources.files import normal_path
from .lexical import gram_sizes, index_search, remove_chunks, replace_chunks, trigram_index
from .merkle import merkle_root, sync_chunks, tree_diff

CHUNK = ("chunk_id", "file_path", "source", "content_hash")


def _leaves(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.col("content_hash").alias("hash"))


@dataclass
class ChunkIndex:
    """``chunks`` (chunk_id, file_path, source, content_hash, ...) and all that is derived from them, as tables.

    Chunks without an id are left out; of chunks with one id the greatest row stands.
    """

    chunks: DataFrame
    trigrams: DataFrame
    sizes: DataFrame
    synced: DataFrame
    root: str | None
    key: str

    @classmethod
    def build(cls, chunks: DataFrame, key: str) -> ChunkIndex:
        own = settle(_distinct(chunks))
        trigrams = settle(trigram_index(own, "chunk_id", "source"))
        sent = settle(sync_chunks(own, own.limit(0), key).select("chunk_id", "content_hash", "remote_id"))
        return cls(own, trigrams, settle(gram_sizes(trigrams)), sent, _root(own), key)

    def update(self, fresh: DataFrame, changed_paths: DataFrame) -> tuple[ChunkIndex, dict]:
        """(the index after the files of ``changed_paths`` hold the chunks ``fresh`` only, a report).

        Chunks of other files stay. Only chunks that are new or have another hash are indexed and sent again,
        only chunks that are gone are taken out. The report has changed, deleted, upserted, skipped and
        merkle_root. The tables of the older index stay readable until they are released.
        """
        paths = changed_paths.select(normal_path(F.col("path")).alias("__path")).dropna().distinct()
        kept = self.chunks.join(paths, normal_path(F.col("file_path")) == F.col("__path"), "left_anti")
        after = settle(_distinct(kept.unionByName(fresh.select(*self.chunks.columns))))
        change = settle(tree_diff(_leaves(self.chunks), _leaves(after)))
        changed = change.filter("change = 'changed'").select("chunk_id")
        gone = change.filter("change = 'deleted'").select("chunk_id")
        again = after.join(changed, "chunk_id", "left_semi")
        trigrams = settle(remove_chunks(replace_chunks(self.trigrams, again, id_column="chunk_id", text_column="source"), gone))
        actions = settle(sync_chunks(after, self.synced, self.key))
        sizes = settle(self.sizes.join(change.select(F.col("chunk_id").alias("id")), "id", "left_anti").unionByName(gram_sizes(trigrams.join(changed.withColumnRenamed("chunk_id", "id"), "id", "left_semi"))))
        counts = {r[0]: r[1] for r in change.groupBy("change").count().collect() + actions.groupBy("action").count().collect()}
        index = ChunkIndex(after, trigrams, sizes, settle(actions.select("chunk_id", "content_hash", "remote_id")), _root(after), self.key)
        report = {"changed": counts.get("changed", 0), "deleted": counts.get("deleted", 0), "upserted": counts.get("upsert", 0), "skipped": counts.get("skip", 0), "merkle_root": index.root}
        for table in (change, actions):
            release(table)
        return index, report

    def search(self, query: str, k: int = 10) -> DataFrame:
        """id, jaccard, score of the chunks nearest to the query, read from the trigram index."""
        return index_search(self.trigrams, self.sizes, query, k)

    def indexed_files(self) -> DataFrame:
        return self.chunks.select("file_path").dropna().distinct()

    def release(self) -> None:
        for table in (self.chunks, self.trigrams, self.sizes, self.synced):
            release(table)


def _distinct(chunks: DataFrame) -> DataFrame:
    rest = [c for c in chunks.columns if c != "chunk_id"]
    rows = chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.max(F.struct(*rest)).alias("row"))
    return rows.select("chunk_id", "row.*").select(*chunks.columns)


def _root(chunks: DataFrame) -> str | None:
    row = merkle_root(_leaves(chunks)).first()
    return row["root"] if row else None
