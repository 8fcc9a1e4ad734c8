"""Session settings shared by every flow."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Whole source files travel as rows, so an Arrow batch is bounded by bytes as well as by rows; a
# tree takes many times the room of its text.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.session.timeZone": "UTC",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="riskweave-"), "riskweave")
    archive = shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on and make the package known to workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may lack that setting; it gets a local folder.  Elsewhere executors
    would each write to a disk of their own, so the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, row_bytes: int = 0) -> DataFrame:
    """Write a result that several later jobs read, and read it back.

    The written table cuts the lineage and outlives lost executors, which cached blocks do not.  With
    ``row_bytes``, about what a wide row takes, few rows share a row group, which is what a reader holds.
    """
    path = scratch_dir(df.sparkSession, name)
    writer = df.write
    if row_bytes:
        writer = writer.option("parquet.block.size", 16 << 20).option("parquet.page.size.row.check.min", max(1, (4 << 20) // row_bytes))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when the input has fewer splits than cores.

    A large table arrives in far more splits than that and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, *keys)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it


def release() -> None:
    """Give freed memory back to the system.

    Spark keeps a task's Python worker for later tasks and stages; without this each keeps the most it ever held.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def released(run: Callable) -> Callable:
    """A task's function over batches, which leaves no freed memory with its worker."""

    def to_the_end(batches):
        yield from run(batches)
        release()

    return to_the_end
