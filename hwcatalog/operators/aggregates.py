"""Statistics, facets, summaries, votes and other aggregations of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PREFIX_VOTES, STORAGE_BYTES, STORAGE_FAIL, STORAGE_WARN, TYPE_FALLBACK
from ..functions.text import class_map
from ..functions.versions import version_chunks


def stats(drivers: DataFrame, hwids: DataFrame, sync_log: DataFrame) -> DataFrame:
    """One row of counts, and the last sync run."""
    d = drivers.agg(F.count("*").alias("drivers"), F.count_distinct(F.when(F.col("provider") != "", F.col("provider"))).alias("providers"), F.count_if(~F.col("enabled")).alias("disabled"))
    h = hwids.agg(F.count("*").alias("hwids"))
    none = drivers.join(hwids.select("driver_id").distinct(), "driver_id", "left_anti").agg(F.count("*").alias("without_hwid"))
    last = sync_log.agg(F.max_by("id", F.struct("run_at", "id")).alias("last_sync_id"))
    return d.crossJoin(h).crossJoin(none).crossJoin(last)  # one row each


def facets(drivers: DataFrame, names: tuple[str, ...] = ("category", "provider", "arch")) -> DataFrame:
    """(facet, value, n) of the enabled drivers' values, in one pass over them."""
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in names))
    rows = drivers.where("enabled").select(F.explode(pairs).alias("f")).select("f.*").where("coalesce(value, '') <> ''")
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n")).orderBy("facet", F.desc("n"), "value")


def category_summary(entries: DataFrame) -> DataFrame:
    """(category, n) of enabled entries by type, else category, else Other."""
    c = F.coalesce(F.nullif("driver_type", F.lit("")), F.nullif("category", F.lit("")), F.lit(TYPE_FALLBACK))
    return entries.where("enabled").groupBy(c.alias("category")).agg(F.count("*").alias("n")).orderBy("category")


def category_by_file(entries: DataFrame) -> DataFrame:
    return entries.where("enabled").groupBy(F.regexp_replace("source_manifest", r"\.manifest.*$", "").alias("category")).agg(F.count("*").alias("n"))


def off_stem(entries: DataFrame) -> DataFrame:
    """(source_manifest, n) of enabled entries whose type isn't that of the file they are in."""
    stem = F.regexp_replace("source_manifest", r"\.manifest.*$", "")
    return entries.where("enabled").where(F.coalesce("driver_type", F.lit("")) != stem).groupBy("source_manifest").agg(F.count("*").alias("n"))


def driver_type(records: DataFrame, key: str) -> DataFrame:
    """(key, driver_type): the class's type, else the type that most id prefixes vote for (the first seen of equals), else Other.

    ``records`` has category, hwids and compatible_ids; generic ids vote in both lists.
    """
    known = F.element_at(class_map(), F.lower(F.trim(F.coalesce("category", F.lit("")))))
    votes = F.create_map(*(F.lit(x) for p in PREFIX_VOTES.items() for x in p))
    ids = F.concat(F.coalesce("hwids", F.array().cast("array<string>")), F.coalesce("compatible_ids", F.array().cast("array<string>")))
    base = records.select(key, known.alias("known"), ids.alias("ids"))
    v = base.select(key, F.posexplode("ids").alias("pos", "id")).withColumn("t", F.element_at(votes, F.concat(F.substring_index(F.upper("id"), "\\", 1), F.lit("\\")))).where(F.col("t").isNotNull() & F.col("id").contains("\\"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    top = v.groupBy(key, "t").agg(F.count("*").alias("n"), F.min("pos").alias("first")).withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "t")
    return base.join(top, key, "left").select(key, F.coalesce("known", "t", F.lit(TYPE_FALLBACK)).alias("driver_type"))


def majority(rows: DataFrame, group: str, value: str, pos: str, default: str | None = None) -> DataFrame:
    """(group, value): the most frequent value, the first seen of equals."""
    per = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    top = per.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first"))).where("r = 1").select(group, value)
    return top.fillna({value: default}) if default else top


def pack_name(rows: DataFrame) -> DataFrame:
    """(folder, name) from each folder's most frequent provider, category (not Unknown) and arch; else the folder's name."""
    modes = rows.select("folder").distinct()
    for c in ("provider", "category", "arch"):
        kept = rows.where(F.coalesce(c, F.lit("")) != "")
        modes = modes.join(majority(kept.where("category <> 'Unknown'") if c == "category" else kept, "folder", c, "pos"), "folder", "left")
    name = F.array_join(F.array("provider", "category", "arch"), "_")
    return modes.select("folder", F.when(name == "", F.substring(F.substring_index("folder", "/", -1), 1, 20)).otherwise(name).alias("name"))


def folder_groups(files: DataFrame) -> DataFrame:
    """(folder, files) with names in order."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.sort_array(F.collect_list("path")).alias("files"))


def folder_records(rows: DataFrame) -> DataFrame:
    """A record a folder with ids: all ids, the highest version and date, the first provider, how many files; ``rows`` has pos, version, provider, driver_date, hwids."""
    v = version_chunks(F.col("version"))
    g = rows.groupBy("folder").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hwids")))).alias("hwids"), F.max_by("version", F.struct(v, -F.col("pos"))).alias("version"), F.max("driver_date").alias("driver_date"),
        F.min_by("provider", F.when(F.coalesce("provider", F.lit("")) != "", F.col("pos"))).alias("provider"), F.count("*").alias("files"),
    )
    return g.where(F.size("hwids") > 0)


def representative(rows: DataFrame, group: str) -> DataFrame:
    """Per group the row with the most ids, the first of equals."""
    w = Window.partitionBy(group).orderBy(F.desc(F.size("hwids")), "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def installer_packages(files: DataFrame) -> DataFrame:
    """(package, exes, representative, bytes) from executables (path, size): one at the top is its own package, others go by their outermost folder, which the largest stands for."""
    package = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.col("path"))
    return files.groupBy(package.alias("package")).agg(F.count("*").alias("exes"), F.max_by("path", F.struct("size", "path")).alias("representative"), F.sum("size").alias("bytes"))


def unique_stems(rows: DataFrame) -> DataFrame:
    """``rows`` (pos, stem) with names made unique: _1, _2, … in order where a stem repeats."""
    w = Window.partitionBy("stem")
    n = rows.withColumn("c", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("pos")))
    return n.select("pos", "stem", F.when(F.col("c") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("r").cast("string"))).alias("name"))


def status_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / F.sum("seconds"), 6).alias("speed"))


def manifest_summary(parts: DataFrame) -> DataFrame:
    """(driver_id, parts, bytes) and the grand total, whose driver_id is null."""
    return parts.rollup("driver_id").agg(F.count("*").alias("parts"), F.sum("size_bytes").alias("bytes"))


def zip_bytes(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p["size_bytes"], F.lit(0).cast("long")))


def storage(bytes_: Column, warn: float = STORAGE_WARN, fail: float = STORAGE_FAIL) -> Column:
    """struct<pct, state> of used bytes against the store's ceiling."""
    pct = F.round(100.0 * bytes_ / STORAGE_BYTES, 6)
    return F.struct(pct.alias("pct"), F.when(pct >= fail, "fail").when(pct >= warn, "warn").otherwise("ok").alias("state"))


def first_per(rows: DataFrame, key: Column, pos: str, always: Column | None = None) -> DataFrame:
    """The first row of each key, and every row for which ``always`` holds."""
    always = F.lit(False) if always is None else always
    w = Window.partitionBy("_k", "_a").orderBy(pos)
    out = rows.withColumn("_k", key).withColumn("_a", F.coalesce(always, F.lit(False))).withColumn("_n", F.row_number().over(w))
    return out.where("_n = 1 OR _a").drop("_k", "_a", "_n")


def new_entries(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New entries whose id isn't there yet, the first of a repeated id."""
    return first_per(new.join(existing.select("driver_id"), "driver_id", "left_anti"), F.col("driver_id"), "pos")


