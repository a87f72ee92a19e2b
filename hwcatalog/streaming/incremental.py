"""Incremental loads: a stream of manifest files put into a table, file by file.

``<table>/entries`` holds every entry of every file's newest good version, (driver_id, file, idx, d, live); live is true for one entry of each id, the last by
(file, idx), which is the one that a load of all files in order of name ends with. Ids and parts lie within their entry. ``<table>/files`` holds what is loaded:
(file, modified, digest, ids, without_id, refused).

What a newer version of a file no longer lists goes, ids and parts with it; where another file has the id, that entry counts again. Versions are ordered by
(time of modification, digest), so files that come twice or out of order change nothing. A version that isn't a manifest changes nothing but ``refused``, its
time. Entries without an id are left out and counted in ``without_id``. A file that is deleted stays loaded: a version without entries takes it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshots
from ..operators.load import driver_rows, hwid_rows, part_rows
from ..sources.manifests import kind, parse
from ..sources.scratch import cut, release

FILES = "file string, modified timestamp, digest string, ids array<string>, without_id long, refused timestamp"


def file_name(path: Column) -> Column:
    """A document's name: of the folder file=<name> that it lies in, as ``write_documents`` makes them, or else its own."""
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(path, r"/file=([^/]+)/[^/]+$", 1)  # escaped as a partition's name and again as a URI
    return F.when(folder != "", plain(plain(folder))).otherwise(plain(F.regexp_extract(path, r"[^/]+$", 0)))


def load_stream(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Read new files below ``source`` and load them; ends when all are read."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(source)
    docs = raw.select(file_name(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    return docs.writeStream.foreachBatch(lambda batch, n: load_files(batch.sparkSession, table, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_files(spark: SparkSession, table: str, docs: DataFrame) -> None:
    """Load ``docs`` (file, modified, value), in which a file may come more than once.

    Entries are committed before the list of files, so a load that fails between the two is done over by the next try and ends the same.
    """
    ours = docs.where(F.col("file").rlike(r"\.manifest.*\.json$") & (kind(F.col("file")) == "drivers"))
    held = cut(parse(ours).select("file", "modified", F.sha2("value", 256).alias("digest"), "bad", F.col("m.drivers").alias("drivers")), "batch")
    known = snapshots.read(spark, f"{table}/files")
    known = spark.createDataFrame([], FILES) if known is None else known
    version = F.struct("modified", "digest")
    newest = held.where("NOT bad").groupBy("file").agg(F.max(version).alias("v"))
    fresh = newest.join(known.select("file", version.alias("k")), "file", "left").where("k IS NULL OR v > k").select("file", F.col("v.modified").alias("modified"), F.col("v.digest").alias("digest"))
    changed = cut(held.where("NOT bad").join(fresh, ["file", "modified", "digest"]).dropDuplicates(["file"]), "changed")
    try:
        entries = changed.select("file", F.posexplode("drivers").alias("idx", "d")).where("coalesce(d.id, '') <> ''").select(F.col("d.id").alias("driver_id"), "file", "idx", "d")
        gone = known.join(changed.select("file"), "file").select(F.explode("ids").alias("driver_id"))

        def change(old: DataFrame | None) -> DataFrame:
            both = entries if old is None else old.drop("live").join(changed.select("file"), "file", "left_anti").select(*entries.columns).unionByName(entries)
            place = F.struct("file", "idx")
            return both.join(both.groupBy("driver_id").agg(F.max(place).alias("_last")), "driver_id").select("driver_id", "file", "idx", "d", (place == F.col("_last")).alias("live"))

        snapshots.commit(spark, f"{table}/entries", entries.select("driver_id").union(gone), "driver_id", change)
        has_id = lambda x: F.coalesce(x["id"], F.lit("")) != ""
        loaded = changed.select("file", "modified", "digest", F.array_distinct(F.transform(F.filter("drivers", has_id), lambda x: x["id"])).alias("ids"), F.size(F.filter("drivers", lambda x: ~has_id(x))).cast("long").alias("without_id"))
        bad = held.where("bad").groupBy("file").agg(F.max("modified").alias("refused"))
        rows = loaded.alias("l").join(bad.alias("b"), "file", "full_outer").join(known.alias("k"), "file", "left")
        news = F.col("l.digest").isNotNull() | F.coalesce(F.col("b.refused") > F.col("k.refused"), F.col("k.refused").isNull())
        pick = [F.when(F.col("l.digest").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"k.{c}")).alias(c) for c in ("modified", "digest", "ids", "without_id")]
        snapshots.upsert(spark, f"{table}/files", rows.where(news).select("file", *pick, F.greatest("b.refused", "k.refused").alias("refused")), "file", ())
    finally:
        release(changed)
        release(held)


def _live(spark: SparkSession, table: str) -> DataFrame | None:
    e = snapshots.read(spark, f"{table}/entries")
    return e and e.where("live").select("file", "d")


def drivers(spark: SparkSession, table: str) -> DataFrame | None:
    """Driver rows as loaded; None before the first load, as of the others."""
    e = _live(spark, table)
    return e and driver_rows(e)


def hwids(spark: SparkSession, table: str) -> DataFrame | None:
    e = _live(spark, table)
    return e and hwid_rows(e)


def parts(spark: SparkSession, table: str) -> DataFrame | None:
    e = _live(spark, table)
    return e and part_rows(e)


def files(spark: SparkSession, table: str) -> DataFrame | None:
    return snapshots.read(spark, f"{table}/files")
