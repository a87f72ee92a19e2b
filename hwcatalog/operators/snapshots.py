"""Tables kept as snapshots: a folder for each bucket of the key; a commit writes the buckets that it touches anew, and then a mark that names every bucket's folder.

A reader follows the newest mark, so it sees a whole commit or none of it, and folders that it reads are never overwritten. A mark is put in place by a
rename that fails where the file is there already: of two writers that began from one snapshot the second gets an error and may begin again. What a failed
commit has written no mark names; ``vacuum`` deletes it.

Rows need a key (a null one is an error). A table's columns are those of its first commit. A commit that touches nothing makes no mark.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import cut, release, remove, stored_bytes, swept
from . import load

BUCKETS = 64
#: Bytes at which a file ends and another begins, by the mean JSON size of the rows put in.
FILE_BYTES = 15 << 20
#: Bytes of stored files, old and new ones, that an upsert changes in one go: what it shuffles takes a few times as much of the disk, however large the table.
AT_ONCE = 1 << 30
#: Name of the folders of buckets; a table can't have a column of this name.
BUCKET = "_bucket"


class Mark(NamedTuple):
    """A commit: its number from 1, the number of buckets, the columns, and the folder of each bucket with rows."""

    version: int
    buckets: int
    schema: str
    folders: dict[int, str]


class Conflict(RuntimeError):
    """Another writer has committed first."""


def bucket_of(key: str, buckets: int) -> Column:
    return F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row without {key}")).cast("int")).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits that can be read."""
    return [int(n[2:-5]) for n in _names(spark, f"{path}/marks") if n.startswith("v=") and n.endswith(".json")]


def mark(spark: SparkSession, path: str, version: int | None = None) -> Mark | None:
    """The newest mark or that of a version; None of a table without commits."""
    if version is None:
        version = max(versions(spark, path), default=None)
    if version is None:
        return None
    m = json.loads(spark.read.option("wholetext", True).text(f"{path}/marks/v={version:08d}.json").first().value)
    return Mark(m["version"], m["buckets"], m["schema"], {int(b): f for b, f in m["folders"].items()})


def _put(spark: SparkSession, path: str, m: Mark) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    ready, last = fs.Path(f"{path}/marks/_{uuid.uuid4().hex}"), fs.Path(f"{path}/marks/v={m.version:08d}.json")
    out = ready.getFileSystem(conf).create(ready)
    out.write(bytearray(json.dumps(m._asdict()).encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)  # no overwriting
    try:
        fs.FileContext.getFileContext(ready.toUri(), conf).rename(ready, last, never)
    except Exception as e:
        remove(spark, ready.toString())
        if m.version in versions(spark, path):
            raise Conflict(f"version {m.version} of {path} is there already") from e
        raise


def _rows(spark: SparkSession, path: str, m: Mark, only: list[int] | None = None) -> DataFrame:
    at = [f"{path}/{f}/{BUCKET}={b}" for b, f in sorted(m.folders.items()) if only is None or b in only]
    schema = StructType.fromJson(json.loads(m.schema))
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of the newest snapshot or of a version; None of a table without commits."""
    m = mark(spark, path, version)
    return m and _rows(spark, path, m)


def lookup(spark: SparkSession, path: str, key: str, values: list[str]) -> DataFrame | None:
    """Rows of some keys, of which a caller names a few: only their buckets are read."""
    m = mark(spark, path)
    if m is None:
        return None
    asked = spark.createDataFrame([(v,) for v in values], f"{key} string").select(bucket_of(key, m.buckets).alias("b")).distinct()
    return _rows(spark, path, m, [r.b for r in asked.collect()]).where(F.col(key).isin(values))


def commit(spark: SparkSession, path: str, keys: DataFrame, key: str, change: Callable[..., DataFrame], buckets: int = BUCKETS, rows_per_file: int = 0, at_once: int = 0) -> Mark | None:
    """Put ``change(rows)`` in the place of the rows that share a bucket with ``keys``; the new mark.

    ``change`` gets the stored rows of those buckets (None in a table without commits) and returns all that shall be there; rows of other buckets are an error.
    With ``at_once``, where ``keys`` were cut, buckets whose files and those of ``keys`` have more bytes are changed in several goes, each written before the next begins, and all
    by one mark: ``change`` gets the rows of one go's buckets, and a condition that holds for the keys of those buckets.
    """
    m = mark(spark, path)
    n = m.buckets if m else buckets
    touched = [r.b for r in keys.select(bucket_of(key, n).alias("b")).distinct().collect()]  # one number a bucket
    if not touched:
        return m
    goes = 1
    if at_once:
        there = [f"{path}/{m.folders[b]}/{BUCKET}={b}" for b in touched if b in m.folders] if m else []
        goes = min(len(touched), max(1, math.ceil(stored_bytes(spark, keys._cut_path, *there) / at_once)))
    folders, b = {x: f for x, f in (m.folders if m else {}).items() if x not in touched}, bucket_of(key, n)
    for i in range(goes):
        part = sorted(touched)[i::goes]
        old = m and _rows(spark, path, m, part)
        out = change(old, b.isin(part)) if goes > 1 else change(old)
        if BUCKET in out.columns:
            raise ValueError(f"a column named {BUCKET}")
        if m and sorted(out.columns) != sorted(StructType.fromJson(json.loads(m.schema)).names):
            raise ValueError(f"other columns than the table's: {out.columns}")
        dealt = out.withColumn(BUCKET, F.when(b.isin(part), b).otherwise(F.raise_error(F.lit("a row of a bucket that isn't touched")).cast("int")))
        folder = f"data/{uuid.uuid4().hex}"
        # a bucket's rows in few files; a large bucket is split by adaptive execution
        with swept(spark):
            dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{folder}")
        folders |= {int(x.split("=")[1]): folder for x in _names(spark, f"{path}/{folder}") if x.startswith(f"{BUCKET}=")}
    new = Mark(m.version + 1 if m else 1, n, m.schema if m else out.schema.json(), folders)
    _put(spark, path, new)
    return new


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "driver_id", keep: tuple[str, ...] = ("created_at",), buckets: int = BUCKETS, file_bytes: int = FILE_BYTES, merged: dict[str, Callable[[Column, Column], Column]] | None = None) -> Mark | None:
    """Put rows, one a key, into a table: as ``load.upsert``, but only the buckets of those keys are read and written.

    ``merged`` makes a column's value from the old one (null of a new row) and the new one.
    """
    mine = getattr(new, "_cut_path", None) is None  # what the caller has cut isn't written again
    held = cut(new, "upsert") if mine else new
    try:
        mean = held.agg(F.avg(F.octet_length(F.to_json(F.struct(*held.columns))))).first()[0] or 1

        def change(old: DataFrame | None, those: Column | None = None) -> DataFrame:
            if old is not None and sorted(old.columns) != sorted(held.columns):
                raise ValueError(f"other columns than the table's: {held.columns}")
            rows = held if those is None else held.where(those)
            return rows if old is None else load.upsert(old, rows, key, keep, merged)

        return commit(spark, path, held, key, change, buckets, max(1, int(file_bytes / mean)), AT_ONCE)
    finally:
        if mine:
            release(held)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all marks but the newest ``keep`` and what none of those names. No writer may be at work, nor a reader of an older snapshot."""
    all_ = sorted(versions(spark, path))
    live = {f"{f}/{BUCKET}={b}" for v in all_[-keep:] for b, f in mark(spark, path, v).folders.items()}
    for v in all_[:-keep]:
        remove(spark, f"{path}/marks/v={v:08d}.json")
    for name in _names(spark, f"{path}/data"):
        held = _names(spark, f"{path}/data/{name}")
        dead = [x for x in held if f"data/{name}/{x}" not in live]
        if not any(f"data/{name}/{x}" in live for x in held):
            remove(spark, f"{path}/data/{name}")
        else:
            for x in dead:
                remove(spark, f"{path}/data/{name}/{x}")
