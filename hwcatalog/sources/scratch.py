"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under a temporary folder where that is unset and Spark is local; it goes when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "hwcatalog")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before us; the folder is scratch space
        return


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """For writes: what their queries have shuffled is deleted when each ends, not when the driver's JVM next collects garbage."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files below folders."""
    found = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths)
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in found)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to a shared folder and read it back, so that its lineage ends and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, what)
    with swept(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what ``cut`` or a function built on it wrote for ``df``, if it did."""
    if path := getattr(df, "_cut_path", None):
        remove(df.sparkSession, path)
