"""Shared pieces: tables cut to the shared folder, connected components, byte-level word hashes."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here reads it (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: Documents of a file, where a stage works on whole texts.
DOCS = 2000
#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own if that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "hwcatalog-shared")
        os.makedirs(found, exist_ok=True)
        found = f"file://{found}"
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before us; the folder is scratch space
        return


def cut(df: DataFrame, what: str = "cut", rows: int | None = None, per_file: int = 100_000) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    ``rows``, where it is known, is about how many rows ``df`` may have: it is then written in files of about ``per_file``
    rows, not one for each partition of whatever was read or shuffled last; more than that many files are never made.
    The shuffle files of the write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / per_file)))
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for ``df``, if it did."""
    if path := getattr(df, "_cut_path", None):
        remove(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Components of an undirected graph by alternating large and small stars: (node, comp), comp the least node.

    Only nodes with an edge to another node appear. Each round keeps at most as many edges as it was
    given, hubs are minima taken with partial aggregation and joined back (a skewed join that Spark
    can split), and a round's edges are written to the shared folder before the next begins.
    """
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges", rows=edges.count())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = state(e)
    while now[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a != b").distinct()
        nxt = cut(small, "edges", rows=2 * now[0])
        then = state(nxt)
        release(e)
        e, same, now = nxt, then == now, then
        if same:
            break
    out = e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select("b", "b").distinct())
    out._cut_path = e._cut_path
    return out


def blocked_pairs(rows: DataFrame, left: str, condition: str, block: int) -> DataFrame:
    """Distinct pairs (u, v) of ids of ``rows`` (key, id and others) with one key, the first with ``left``, for which ``condition`` holds.

    The condition names the two rows' columns x_name and y_name. The rows of a key are dealt to blocks of about ``block`` on
    either side, so no key is looked through in one task, and only pairs that pass become rows.
    """
    rows = rows.withColumn("l", F.expr(left))
    sizes = rows.groupBy("key").agg(F.ceil(F.count_if("l") / block).cast("int").alias("ni"), F.ceil(F.count("*") / block).cast("int").alias("nj"), F.count("*").alias("c")).where("ni > 0 AND c > 1")
    dealt = rows.join(sizes.drop("c"), "key")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = [n for n in rows.columns if n != "key"]
    x = dealt.where("l").select("key", own("ni").alias("i"), upto("nj").alias("j"), *(F.col(n).alias(f"x_{n}") for n in names))
    y = dealt.select("key", upto("ni").alias("i"), own("nj").alias("j"), *(F.col(n).alias(f"y_{n}") for n in names))
    hits = x.join(y, ["key", "i", "j"]).where(f"({condition}) AND x_id != y_id AND (NOT y_l OR x_id < y_id)")
    return hits.select(F.least("x_id", "y_id").alias("u"), F.greatest("x_id", "y_id").alias("v")).distinct()


_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, n)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INV)]
    return _powers


def word_hashes(data: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts laid end to end in ``data``; and for each text the index after its last word."""
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    cuts = np.zeros(len(data) + 1, bool)
    cuts[ends] = True
    cuts[0] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cuts[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | cuts[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * up[: len(data)])])
        h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, ends)


def long_word_hashes(data: np.ndarray, piece: int = 1 << 21) -> np.ndarray:
    """Hashes of all words of one text of any length, piece by piece: cuts fall on white space, so memory follows the number of words."""
    found, at = [], 0
    while at < len(data):
        end = min(at + piece, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # to the end of the word, however long
            step = np.flatnonzero(_SPACE[data[end : end + 65536]])
            end += int(step[0]) if len(step) else min(65536, len(data) - end)
        found.append(word_hashes(data[at:end], np.array([end - at]))[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def text_slices(column, most: int = 1 << 20):
    """Cut an Arrow text column into runs of whole texts of about ``most`` bytes: (first row, bytes, ends of the texts)."""
    import pyarrow as pa

    big = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1]
    data = np.frombuffer(big.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(big):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i + 1 : j + 1] - off[i]
        i = j
