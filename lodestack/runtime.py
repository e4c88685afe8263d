"""Session-level helpers: reading tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that they need no path to the repository.

    The driver serves the archive; executors fetch it, also those that join later.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    try:
        archive = Path(tempfile.mkdtemp(prefix="lodestack-code-")) / "lodestack.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, Path(package.name) / file.relative_to(package))
        context.addPyFile(str(archive))
    except OSError:
        pass  # then the executors have to find the package themselves


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; timestamps keep their stored kind, columns are pruned by the reader."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary folder that is removed at exit. On a
    cluster a folder of the driver's machine would hold what executors can't reach, so that is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestack-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it back: survives lost executors, no lineage.

    Its files are removed with their DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is
    true, as in :func:`local_session`; loops free those of earlier rounds with :func:`release`.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame | None) -> None:
    """Remove the files of a DataFrame made by :func:`cut` or :func:`settle` that nothing reads any more."""
    if df is None:
        return
    path = getattr(df, "_settled", None)
    if path is not None:
        _SETTLED[:] = [s for s in _SETTLED if s[1] != path]
    else:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        path = file.get() if file is not None and file.isDefined() else None
    if path is not None:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SETTLED: list = []


def settle(df: DataFrame) -> DataFrame:
    """As :func:`cut`, but as a compressed columnar table, for results that are read several times.

    The table stays until it is released or the application ends.
    """
    spark = df.sparkSession
    if not _SETTLED:
        atexit.register(_remove_settled)
    path = f"{checkpoint_folder(spark)}/settled-{uuid.uuid4().hex}"
    _SETTLED.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _remove_settled() -> None:
    for spark, path in _SETTLED:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass
    _SETTLED.clear()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def fingerprint(*columns) -> "F.Column":
    """A non-negative 63-bit hash used for salts and deterministic samples."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def clash_free(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns an operator needs, so that extra columns of the caller can't clash with its own."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*wanted)


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("LODESTACK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
