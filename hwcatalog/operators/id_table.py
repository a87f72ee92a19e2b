"""Hardware ids stored for point lookups: a folder a bucket of the upper-cased id, sorted by it, with Bloom filters.

A lookup of a few ids reads the folders of their buckets, and in them the row groups whose range and Bloom filter allow the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hwid import ladder, unescape
from .search import hwid_lookup

BUCKETS = 64
#: Ids that are looked up by filters on the stored table; more are joined.
FEW = 2000
#: Bytes of a row group.
ROW_GROUP = 1 << 20
#: Ids that a row group's Bloom filter is made for: as many as it may hold at some 40 bytes a row.
ROW_GROUP_IDS = 25_000


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store(hwids: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write ``hwids`` (hwid_string, driver_id and others) below ``path``, each pair once; rows with a null or empty id or no driver are left out."""
    rows = hwids.where("coalesce(hwid_string, '') <> '' AND driver_id IS NOT NULL").withColumn("key", F.upper("hwid_string"))
    # an id that very many drivers have is dealt to several files of its bucket; equal pairs meet by the same deal
    dealt = ["bucket", "key", "_deal"]
    spread = rows.withColumn("bucket", _bucket("key", buckets)).withColumn("_deal", F.pmod(F.xxhash64("driver_id"), F.lit(8))).repartition(*dealt).dropDuplicates([*dealt, "hwid_string", "driver_id"]).drop("_deal")
    out = spread.sortWithinPartitions("bucket", "key", "driver_id").write.partitionBy("bucket").option("compression", "zstd")
    out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(ROW_GROUP_IDS))  # without a number each filter has a megabyte
    out.option("parquet.block.size", str(ROW_GROUP)).option("maxRecordsPerFile", 2_000_000).parquet(path)


def rows_of(spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Stored rows of some upper-cased ids, at most ``FEW``: the filters reach the scan."""
    asked = spark.createDataFrame([(k,) for k in keys], "key string").select(_bucket("key", buckets).alias("b")).distinct()
    return spark.read.parquet(path).where(F.col("bucket").isin([r.b for r in asked.collect()]) & F.col("key").isin(keys)).drop("bucket")


def lookup(spark: SparkSession, path: str, queries: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(query, matched_at, level, exact, driver_id): as ``search.hwid_lookup`` over the stored ids, for ids that a caller asks for."""
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    if len(queries) > FEW:
        return hwid_lookup(spark.read.parquet(path), asked)
    rungs = asked.select(F.explode(ladder(unescape(F.col("query")))).alias("rung")).select(F.upper("rung").alias("k")).distinct()
    keys = [r.k for r in rungs.collect()]  # a few for each of at most FEW queries
    return hwid_lookup(rows_of(spark, path, keys, buckets), asked)
