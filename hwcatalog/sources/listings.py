"""Driver listings of a system ("Key : Value" blocks), and which store folder holds a driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LISTING_LABELS


def parse_listing(texts: DataFrame) -> DataFrame:
    """(source, n, published, original, provider, class_name, driver_version, pkg_path) of each block of ``texts`` (source, value) with a published name.

    A value is what follows the first colon; of a label that repeats in a block the last counts.
    """
    label = F.create_map(*(F.lit(x) for p in LISTING_LABELS.items() for x in p))
    blocks = texts.select("source", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]*(?=\n)")).alias("n", "block"))
    lines = blocks.select("source", "n", F.posexplode(F.split("block", "\n")).alias("i", "line")).where(F.col("line").contains(":"))
    lines = lines.select("source", "n", "i", F.element_at(label, F.lower(F.trim(F.substring_index("line", ":", 1)))).alias("k"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("v")).where("k IS NOT NULL")
    names = list(dict.fromkeys(LISTING_LABELS.values()))
    out = lines.groupBy("source", "n").agg(*(F.max_by(F.when(F.col("k") == x, F.col("v")), F.when(F.col("k") == x, F.col("i"))).alias(x) for x in names))
    return out.where(F.coalesce("published", F.lit("")) != "")


def find_folders(records: DataFrame, folders: DataFrame) -> DataFrame:
    """``records`` (published, original, pkg_path) with the folder that holds each: its own path, else the first store folder named after
    the original file, else one that contains it. ``folders``: (folder, files array)."""
    name = F.lower("original")
    stem = F.regexp_extract(F.lower("folder"), r"^(.*?\.inf)(?:_.*)?$", 1)
    named = folders.select(stem.alias("k"), "folder", F.lit(2).alias("rank"))
    holding = folders.select(F.explode(F.transform("files", lambda x: F.lower(x))).alias("k"), "folder", F.lit(3).alias("rank"))
    own = records.where(F.coalesce("pkg_path", F.lit("")) != "").select("published", "original", F.col("pkg_path").alias("folder"), F.lit(1).alias("rank"))
    # one folder a name, before records meet them
    first = named.union(holding).where("k <> ''").groupBy("k").agg(F.min(F.struct("rank", "folder")).alias("b"))
    hit = records.withColumn("k", name).join(first, "k").select("published", "original", "b.folder", "b.rank")
    best = own.union(hit).groupBy("published", "original").agg(F.min(F.struct("rank", "folder")).alias("b")).select("published", "original", "b.folder", "b.rank")
    return records.join(best, ["published", "original"], "left")


def volume_name(file: Column) -> tuple[Column, Column]:
    """(stem, number) of a split archive's volume; nulls for other files."""
    pattern = r"(?i)^(.*\.7z)\.(\d{3,})$"
    return F.nullif(F.lower(F.regexp_extract(file, pattern, 1)), F.lit("")), F.regexp_extract(file, pattern, 2).try_cast("int")
