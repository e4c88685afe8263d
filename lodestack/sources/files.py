"""Reading source trees, keeping tables, settings."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Folders of tools and builds that are never read.
SKIPPED = (".git", "target", "node_modules", ".cache", ".idea", ".vscode")


def source_files(spark: SparkSession, root: str, ending: str = "rs") -> DataFrame:
    """path (relative to the root), text, ext of all files with one ending, skipped folders left out."""
    base = os.path.abspath(root).rstrip("/")
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ending}").load(base)
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/+", "/")
    relative = F.expr(f"substring(p, {len(base) + 2})")
    parts = F.split("path", "/")
    return files.select(path.alias("p"), F.col("value").alias("text")).select(relative.alias("path"), "text").filter(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), F.array(*(F.lit(s) for s in SKIPPED))) | (F.size(parts) == 1)).withColumn("ext", F.lit(ending))


def file_set(rows: DataFrame, order: str | None = None) -> DataFrame:
    """path, text, ext: of a path inserted several times the last by ``order`` stands (else the greatest text)."""
    last = F.col(order) if order else F.col("text")
    one = Window.partitionBy("path").orderBy(last.desc_nulls_last(), F.col("text").desc_nulls_last())
    return rows.filter("path is not null").withColumn("__n", F.row_number().over(one)).filter("__n = 1").select("path", "text", F.regexp_extract("path", r"\.(\w+)$", 1).alias("ext"))


def listing(nodes: DataFrame) -> DataFrame:
    """file_path, nodes: paths in one style with the number of their nodes."""
    return nodes.filter("file_path is not null").groupBy(normal_path(F.col("file_path")).alias("file_path")).agg(F.countDistinct("node_id").alias("nodes"))


def normal_path(path):
    """Forward slashes, no dots or doubled slashes within."""
    slashed = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"(^|/)(\./)+", "$1"), "/$", "")


def normal(path: str) -> str:
    """:func:`normal_path` of one path."""
    slashed = re.sub("/{2,}", "/", path.replace("\\", "/"))
    return re.sub("/$", "", re.sub(r"(^|/)(\./)+", r"\1", slashed))


@dataclass
class Store:
    """Named tables under one folder.

    Every save writes a version of its own and then replaces the file that names the current one by a rename,
    so a reader finds either the old or the new version, whole. The version before the current one stays for
    those who still read it; older ones are removed.
    """

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._files().exists(self._path(f"{name}/current"))

    def _versions(self, name: str) -> list[str]:
        """The names of the current version and of the one before it; none of a table that was never saved."""
        if not self.exists(name):
            return []
        stream = self._files().open(self._path(f"{name}/current"))
        try:
            return stream.readUTF().split()
        finally:
            stream.close()

    def save(self, name: str, df: DataFrame) -> None:
        """Put ``df`` in place of the table, from which it may read itself."""
        version, before = f"v{uuid.uuid4().hex}", self._versions(name)
        df.write.parquet(f"{self.folder}/{name}/{version}")
        files, ready = self._files(), self._path(f"{name}/{version}.next")
        stream = files.create(ready, False)
        stream.writeUTF(" ".join([version, *before[:1]]))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        replace = self.spark.sparkContext._gateway.new_array(kind, 1)
        replace[0] = kind.OVERWRITE
        context.rename(ready, self._path(f"{name}/current"), replace)
        for old in before[1:]:
            files.delete(self._path(f"{name}/{old}"), True)

    def load(self, name: str, schema: StructType | str | None = None) -> DataFrame | None:
        """The table, or None when it was never saved."""
        if not self.exists(name):
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.folder}/{name}/{self._versions(name)[0]}")


@dataclass
class FusionConfig:
    k: float = 60.0
    weights: list[float] = field(default_factory=lambda: [1.0, 1.0, 1.0])
    score_alpha: float = 0.0


@dataclass
class SearchConfig:
    candidate_multiplier: int = 4
    proximity_scale: float = 6.0
    context_weight: float = 4.0


@dataclass
class ContextConfig:
    budget: int = 4000
    dependency_budget: int = 2400
    max_dependencies: int = 5
    surrounding_lines: int = 16
    keep_threshold: float = 0.70
    prune: bool = True


@dataclass
class Settings:
    rrf: FusionConfig = field(default_factory=FusionConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    context: ContextConfig = field(default_factory=ContextConfig)
    debounce_ms: int = 150
    alias_key: str = "workspace"
    watch_debounce_ms: int = 500
    rate_burst: int = 60
    rate_refill: float = 10.0

    @classmethod
    def load(cls, text: str = "", env: dict[str, str] | None = None, prefix: str = "LODESTACK_") -> Settings:
        """Partial JSON (or YAML where a reader for it is installed) over the defaults, then the environment.

        A variable names its place with double underscores: LODESTACK_CONTEXT__BUDGET=3000.
        """
        out = cls()
        _put(out, _parse(text) if text.strip() else {})
        for name, value in (os.environ if env is None else env).items():
            if name.startswith(prefix):
                path = name[len(prefix) :].lower().split("__")
                tree: dict = {}
                node = tree
                for part in path[:-1]:
                    node = node.setdefault(part, {})
                try:
                    node[path[-1]] = json.loads(value)
                except ValueError:
                    node[path[-1]] = value
                _put(out, tree)
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def _parse(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # installed only in some places; plain JSON needs nothing

        return yaml.safe_load(text) or {}


def _put(target, values: dict) -> None:
    known = {f.name for f in fields(target)}
    for name, value in values.items():
        if name not in known:
            continue
        own = getattr(target, name)
        if is_dataclass(own) and isinstance(value, dict):
            _put(own, value)
        else:
            setattr(target, name, value)
