"""Queries of change detection and vector sync."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, merkle
from ..runtime import checkpoint_folder, table
from ..sources.files import Store
from ..streaming import changes

KEY = "workspace-key"
SEAL = bytes(range(32))
OLD, NEW = 303, 305


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.changed_chunks(table(spark, folder, "vector_store"), table(spark, folder, "merkle_leaves"), table(spark, folder, "sync_runs")).select("chunk_id")


def p5_replay(spark: SparkSession, folder: str) -> DataFrame:
    """What each sync run takes when all keep one ledger: rows that arrive late or fail are taken by the next that succeeds."""
    return incremental.replay(table(spark, folder, "vector_store"), table(spark, folder, "sync_runs"))


def _tree(spark: SparkSession, folder: str, run: int) -> DataFrame:
    leaves = table(spark, folder, "merkle_leaves").filter((F.col("run_id") == run) & F.col("chunk_id").isNotNull())
    return leaves.groupBy("chunk_id").agg(F.max(F.struct("seen_at", incremental.hash_key(F.col("hash")).alias("hash"))).alias("leaf")).select("chunk_id", "leaf.hash")


def merkle_diff(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tree_diff(_tree(spark, folder, OLD), _tree(spark, folder, NEW))


def merkle_root(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.merkle_root(_tree(spark, folder, NEW))


def merkle_first_level(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes just above the leaves."""
    return merkle.merkle_levels(_tree(spark, folder, NEW)).filter("level = 1").select("pos", "hash")


def merkle_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the tree."""
    return merkle.merkle_levels(_tree(spark, folder, NEW))


def snapshot_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What a watcher that compares two listings reports, by kind."""
    old, new = (_tree(spark, folder, run).withColumnRenamed("chunk_id", "path") for run in (OLD, NEW))
    return changes.snapshot_changes(old, new).groupBy("kind").agg(F.count("*").alias("chunks"))


def stored_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by kind after they were saved twice and loaded from a store of named tables."""
    store = Store(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")
    store.save("nodes", table(spark, folder, "nodes").limit(0))
    store.save("nodes", table(spark, folder, "nodes").select("node_id", "kind", "source"))
    return store.load("nodes").groupBy("kind").agg(F.count("*").alias("rows"), F.countDistinct("node_id").alias("nodes"), F.sum(F.octet_length("source")).alias("bytes"))


def latest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = merkle.latest_rows(table(spark, folder, "vector_store").select("chunk_id", "content_hash", "updated_at", "arrived_at").filter("content_hash is not null"))
    return rows.select("chunk_id", "content_hash", "updated_at")


def sync_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many current chunks a sync would send and skip."""
    chunks = incremental.current_rows(table(spark, folder, "vector_store"))
    synced = _tree(spark, folder, NEW).withColumnRenamed("hash", "content_hash")
    return merkle.sync_chunks(chunks, synced, KEY).groupBy("action").agg(F.count("*").alias("chunks"))


def keyed_aliases(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "nodes").select("file_path").dropna().distinct()
    return paths.select("file_path", merkle.keyed_alias(F.col("file_path"), KEY).alias("alias"))


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", merkle.content_hash(F.col("text")).alias("hash"))


def sealed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts encrypted and decrypted again, with the size of what is stored and whether it hides the text."""
    rows = table(spark, folder, "documents").select("doc_id", F.hex("text").alias("plain"), merkle.encrypt(F.col("text"), SEAL).alias("sealed"))
    hidden = ~F.contains("sealed", F.col("plain")) | (F.col("plain") == "")
    return rows.select("doc_id", F.md5(merkle.decrypt(F.col("sealed"), SEAL)).alias("digest"), (F.length("sealed") / 2).cast("long").alias("bytes"), hidden.alias("hidden"))


def file_alias_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each file in the store after the deleted chunks of the newer tree are gone."""
    store = table(spark, folder, "vector_store").select("chunk_id", "file_alias")
    gone = merkle.tree_diff(_tree(spark, folder, OLD), _tree(spark, folder, NEW)).filter("change = 'deleted'")
    return merkle.without_keys(store, gone).groupBy("file_alias").agg(F.countDistinct("chunk_id").alias("chunks"))


QUERIES = {f.__name__: f for f in (p5_found, p5_replay, merkle_diff, merkle_root, merkle_first_level, merkle_nodes, snapshot_changes, stored_round_trip, latest_vectors, sync_report, keyed_aliases, content_hashes, sealed_round_trip, file_alias_counts)}

_TREE = """(SELECT chunk_id, lower(trim(hash)) AS hash FROM merkle_leaves WHERE run_id = {0} AND chunk_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY seen_at DESC NULLS LAST, lower(trim(hash)) DESC NULLS LAST) = 1)"""
_CURRENT = """(SELECT chunk_id, lower(trim(content_hash)) AS hash FROM vector_store WHERE chunk_id IS NOT NULL AND trim(content_hash) <> ''
               QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, arrived_at DESC NULLS LAST, lower(trim(content_hash)) DESC) = 1)"""
_DIFF = f"""SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'deleted' ELSE 'changed' END AS change
            FROM {_TREE.format(OLD)} a FULL JOIN {_TREE.format(NEW)} b ON a.chunk_id = b.chunk_id WHERE a.chunk_id IS NULL OR b.chunk_id IS NULL OR a.hash IS DISTINCT FROM b.hash"""

_LEVELS = f"""
        WITH RECURSIVE leaves AS (SELECT row_number() OVER (ORDER BY chunk_id) - 1 AS pos, hash, count(*) OVER () AS n FROM {_TREE.format(NEW)} WHERE hash IS NOT NULL),
        t(level, pos, hash, n) AS (
            SELECT 0, pos, hash, n FROM leaves
            UNION ALL
            SELECT max(level) + 1, pos // 2, CASE WHEN count(*) = 1 THEN min(hash) ELSE sha256(from_hex('4000000000000000') || encode(min_by(hash, pos)) || encode(max_by(hash, pos))) END, (n + 1) // 2
            FROM t WHERE n > 1 GROUP BY pos // 2, n
        )"""

SQL = {
    "merkle_root": f"{_LEVELS} SELECT hash AS root FROM t WHERE n = 1",
    "merkle_nodes": f"{_LEVELS} SELECT level, pos, hash FROM t",
    "snapshot_changes": f"""
        WITH a AS (SELECT chunk_id, hash AS old FROM {_TREE.format(OLD)}), b AS (SELECT chunk_id, hash AS new FROM {_TREE.format(NEW)})
        SELECT CASE WHEN old IS NULL THEN 'created' WHEN new IS NULL THEN 'deleted' ELSE 'modified' END AS kind, count(*) AS chunks FROM a FULL JOIN b USING (chunk_id) WHERE old IS NULL OR new IS NULL OR old <> new GROUP BY 1
    """,
    "stored_round_trip": "SELECT kind, count(*) AS rows, count(DISTINCT node_id) AS nodes, sum(strlen(source))::BIGINT AS bytes FROM nodes GROUP BY kind",
    "p5_found": f"""
        WITH last AS (SELECT run_id FROM sync_runs WHERE lower(trim(status)) = 'succeeded' AND finished_at IS NOT NULL ORDER BY finished_at DESC, run_id DESC LIMIT 1),
        leaf AS {_TREE.format("(SELECT run_id FROM last)")}, cur AS {_CURRENT}
        SELECT DISTINCT cur.chunk_id FROM cur LEFT JOIN leaf USING (chunk_id) WHERE leaf.hash IS NULL OR leaf.hash <> cur.hash
    """,
    "p5_replay": """
        WITH rows AS (SELECT DISTINCT chunk_id, content_hash, updated_at, arrived_at FROM vector_store WHERE chunk_id IS NOT NULL AND updated_at IS NOT NULL AND arrived_at IS NOT NULL),
        good AS (SELECT DISTINCT run_id, started_at FROM sync_runs WHERE lower(trim(status)) = 'succeeded' AND started_at IS NOT NULL AND run_id IS NOT NULL),
        taken AS (SELECT r.*, g.run_id FROM rows r JOIN good g ON r.arrived_at < g.started_at
                  QUALIFY row_number() OVER (PARTITION BY r.chunk_id, r.content_hash, r.updated_at, r.arrived_at ORDER BY g.started_at, g.run_id) = 1)
        SELECT run_id, count(*) AS rows, count(DISTINCT chunk_id) AS chunks FROM taken GROUP BY run_id
    """,
    "merkle_diff": _DIFF,
    "merkle_first_level": f"""
        WITH n AS (SELECT hash, row_number() OVER (ORDER BY chunk_id) - 1 AS p FROM {_TREE.format(NEW)}),
        z AS (SELECT from_hex('4000000000000000') AS size)
        SELECT a.p // 2 AS pos, CASE WHEN b.hash IS NULL THEN a.hash ELSE sha256(size || encode(a.hash) || encode(b.hash)) END AS hash FROM n a LEFT JOIN n b ON b.p = a.p + 1, z WHERE a.p % 2 = 0
    """,
    "latest_vectors": "SELECT chunk_id, content_hash, updated_at FROM vector_store WHERE chunk_id IS NOT NULL AND content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC NULLS LAST, arrived_at DESC NULLS LAST) = 1",
    "sync_report": f"SELECT CASE WHEN l.hash = c.hash THEN 'skip' ELSE 'upsert' END AS action, count(*) AS chunks FROM {_CURRENT} c LEFT JOIN {_TREE.format(NEW)} l USING (chunk_id) GROUP BY 1",
    "keyed_aliases": f"SELECT DISTINCT file_path, 'f_' || sha256('{KEY}' || file_path) AS alias FROM nodes WHERE file_path IS NOT NULL",
    "content_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "sealed_round_trip": "SELECT doc_id, md5(text) AS digest, strlen(text) + 28 AS bytes, CASE WHEN text IS NULL THEN NULL ELSE true END AS hidden FROM documents",
    "file_alias_counts": f"SELECT file_alias, count(DISTINCT chunk_id) AS chunks FROM vector_store WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM ({_DIFF}) WHERE change = 'deleted') GROUP BY file_alias",
}
