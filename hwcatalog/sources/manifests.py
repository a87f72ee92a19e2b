"""Manifest documents: reading, validating, shard order, and the consumers' shapes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import INDEX, MANIFEST

SHARD = r"manifest\.(\d+)\.json$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of each JSON document below ``path``; a folder file=<name> names the files in it."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", False).text(path)
    return raw.select(F.col("file") if "file" in raw.columns else F.col("_metadata.file_name").alias("file"), "value")


def dealt(docs: DataFrame) -> DataFrame:
    """(file, value) dealt by name to a fixed number of tasks: what is written costs by files, and by bytes alone few small documents' tasks would be put together."""
    return docs.select("file", "value").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (file, value) as one folder a file."""
    dealt(docs).write.mode(mode).partitionBy("file").text(path)


def rewrite_documents(docs: DataFrame, path: str) -> None:
    """Write (file, value) over the files of those names; other files below ``path`` stay as they are, byte for byte."""
    dealt(docs).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").text(path)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, size_bytes) of the documents below ``path``; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).groupBy("file").agg(F.sum("length").alias("size_bytes"))


def discover(docs: DataFrame) -> DataFrame:
    """Files that are manifests, in order of name."""
    return docs.where(F.col("file").rlike(r"\.manifest.*\.json$")).orderBy("file")


def kind(file: Column) -> Column:
    return F.when(F.startswith(file, F.lit("installers.manifest")), "installers").otherwise("drivers")


def parse(docs: DataFrame) -> DataFrame:
    """Documents parsed to m; bad is true where the text isn't a JSON object with a list ``drivers``."""
    first = F.substring(F.btrim("value", F.lit(" \t\r\n")), 1, 1)
    docs = docs.withColumn("m", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    has_list = F.get_json_object("value", "$.drivers").rlike(r"^\s*\[")
    return docs.withColumn("bad", F.coalesce((first != "{") | F.col("m").isNull() | F.col("m._corrupt_record").isNotNull() | ~has_list, F.lit(True)))


def drivers(parsed: DataFrame) -> DataFrame:
    """(file, idx, d) of each item of the good driver manifests; idx is the place in its file."""
    good = parsed.where(~F.col("bad") & (kind(F.col("file")) == "drivers"))
    return good.select("file", F.posexplode("m.drivers").alias("idx", "d"))


def shard_of(file: Column) -> Column:
    """Number of a shard: the base file is 1."""
    n = F.regexp_extract(file, SHARD, 1)
    return F.when(n == "", 1).otherwise(n.try_cast("int"))


def stem_of(file: Column) -> Column:
    return F.regexp_replace(file, r"\.manifest(\.\d+)?\.json$", "")


def shard_order(files: DataFrame) -> DataFrame:
    """(stem, shard, file) of each stem's shards from the base on, up to the first gap."""
    f = files.select("file", stem_of(F.col("file")).alias("stem"), shard_of(F.col("file")).alias("shard"))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("shard"))
    return f.withColumn("n", n).where("n = shard").drop("n")


def shard_groups(files: DataFrame) -> DataFrame:
    """(stem, files) by number for stems with a base file; numbers below 2 after a name aren't shards."""
    f = files.select("file", stem_of(F.col("file")).alias("stem"), shard_of(F.col("file")).alias("shard"), (F.regexp_extract("file", SHARD, 1) != "").alias("numbered"))
    f = f.where("NOT numbered OR shard >= 2")
    groups = f.groupBy("stem").agg(F.min("shard").alias("low"), F.array_sort(F.collect_list(F.struct("shard", "file"))).alias("s"))
    return groups.where("low = 1").select("stem", F.transform("s", lambda x: x["file"]).alias("files"))


def category_list(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known categories first, then other manifests found, each part by name: (category, is_known, n)."""
    k = known.select("category").distinct().withColumn("is_known", F.lit(True))
    o = found.select("category").distinct().join(k, "category", "left_anti").withColumn("is_known", F.lit(False))
    return k.union(o).withColumn("n", F.row_number().over(Window.orderBy(F.desc("is_known"), "category")))


def combined_history(parsed: DataFrame) -> DataFrame:
    """(key, entries): of a key in several shards the last shard's."""
    h = parsed.where("NOT bad").select(stem_of(F.col("file")).alias("stem"), shard_of(F.col("file")).alias("shard"), F.explode("m.version_history").alias("key", "entries"))
    return h.groupBy("key").agg(F.max_by("entries", F.struct("stem", "shard")).alias("entries"))


def read_index(spark: SparkSession, text: str | None) -> DataFrame:
    """An index document, or a blank one where it is missing or unreadable."""
    row = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", INDEX).alias("i"))
    blank = F.struct(F.lit("2").alias("schema"), F.lit("").alias("updated"), F.array().cast("array<struct<filename:string,size_bytes:bigint,active:boolean,note:string>>").alias("manifest_shards"), F.create_map().cast("map<string,bigint>").alias("category_summary"))
    return row.select(F.when(F.col("i").isNull() | F.col("i.manifest_shards").isNull(), blank).otherwise(F.col("i")).alias("i")).select("i.*")


def index_or_listing(index: DataFrame | None, listing: DataFrame | None, known: DataFrame) -> DataFrame:
    """Files to read: the index's; without an index what the listing has, and the known ones; with neither an error, never a guess."""
    if index is not None:
        return index.select(F.explode("manifest_shards.filename").alias("file")).distinct()
    if listing is None:
        raise ValueError("neither the index nor the folder's listing can be read")
    return listing.select("file").union(known.select("file")).distinct()


def first_list(value: Column) -> Column:
    """JSON text of the first of results, drivers, matches, data that is a list; a bare object with an id makes one row."""
    out = F.lit(None).cast("string")
    for key in ("data", "matches", "drivers", "results"):
        x = F.get_json_object(value, f"$.{key}")
        out = F.when(F.startswith(x, F.lit("[")), x).otherwise(out)
    bare = F.get_json_object(value, "$.driver_id").isNotNull() | F.get_json_object(value, "$.id").isNotNull()
    return F.coalesce(out, F.when(bare, F.concat(F.lit("["), value, F.lit("]"))))


def entries_key(drivers_: Column, installers: Column, items: Column) -> Column:
    """The first list that isn't empty."""
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in (drivers_, installers, items)))


def consumer_parts(parts: Column) -> Column:
    """Parts with a file name and an http(s) url, numbered by place among those that stay where a number is missing, in order of number."""
    ok = F.filter(parts, lambda p: (F.coalesce(p["filename"], F.lit("")) != "") & F.coalesce(p["url"], F.lit("")).rlike(r"(?i)^https?://"))
    numbered = F.transform(ok, lambda p, i: F.struct(F.coalesce(p["part_num"], (i + 1).cast("int")).alias("part_num"), p["filename"].alias("filename"), p["url"].alias("url"), p["size_bytes"].alias("size_bytes")))
    return F.array_sort(numbered)


def looks_like_manifest(value: Column) -> Column:
    return F.coalesce(F.get_json_object(value, "$.drivers").rlike(r"^\s*\["), F.lit(False))

