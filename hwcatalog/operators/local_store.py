"""The builder's local store: entries put in by id with their archive parts, bad entries put aside with a reason.

``<path>/drivers`` is a snapshot table of one row an entry with its parts in it, so an entry and its parts are put in by one commit;
``<path>/refused`` holds the bad ones.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import cut, release
from . import snapshots

# fixed values: text fields of an entry with the store's column, and a part's text fields; an absent one is empty, or null for the links
TEXTS = {"id": "driver_id", "pack": "pack", "provider": "provider", "category": "category", "type": "category_type", "version": "version", "arch": "arch"}
LINKS = ["supersedes", "superseded_by"]
PART_TEXTS = ["filename", "sha256", "url"]
COLUMNS = [*TEXTS.values(), "hwid_count", "zip_parts", "date_added", "enabled", *LINKS, "parts"]
#: A part as it is read: one cast a list, so that its fields are looked up once and not by a path for each use.
RAW_PART = "struct<part_num: variant, filename: variant, sha256: variant, url: variant, size_bytes: variant>"
PART = "struct<part_num: int, filename: string, size_bytes: bigint, sha256: string, url: string>"


def _is_nested(x: Column) -> Column:
    """True where a value is a list or an object."""
    kind = F.schema_of_variant(x)
    return F.coalesce(kind.startswith("ARRAY<") | kind.startswith("OBJECT<"), F.lit(False))


def _nested(v: Column, name: str) -> Column:
    return _is_nested(F.try_variant_get(v, f"$.{name}", "variant"))


def _get(v: Column, name: str, kind: str, absent: object) -> Column:
    """A field: null where it is null, ``absent`` where it isn't there."""
    there = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(there.isNull(), F.lit(absent).cast(kind)).otherwise(F.try_variant_get(v, f"$.{name}", kind))


def read_entries(items: DataFrame, today: str) -> DataFrame:
    """``items`` (pos, value: JSON text) as the store's columns, with pos, value and reason, null of a good entry.

    An entry is refused whole: one that is no JSON object, has no id, has a list or an object where a text or number belongs, has ``hwids`` or ``parts`` that
    are no lists, or a part like that or without a number. Absent fields are empty; zip_parts 1, date_added ``today``, enabled true; of a part the number 1, the size 0.
    """
    v, p = F.col("_v"), F.col("_p")
    got = F.try_variant_get("_v", "$.parts", "variant")
    read = items.select("pos", "value", F.try_parse_json("value").alias("_v"))
    ours = read.withColumn("_p", F.when(got.isNull(), F.array().cast(f"array<{RAW_PART}>")).otherwise(F.try_variant_get("_v", "$.parts", f"array<{RAW_PART}>")))  # null where a part is no object, too
    is_object = v.isNotNull() & F.col("value").rlike(r"^[ \t\r\n]*\{")  # schema_of_variant would go through the whole entry
    listed = F.try_variant_get("_v", "$.parts", "array<variant>").isNotNull()
    hwids = F.when(F.try_variant_get(v, "$.hwids", "variant").isNull(), F.lit(0)).otherwise(F.size(F.try_variant_get(v, "$.hwids", "array<variant>")))  # -1 of no list: size of null
    hwids = F.when(F.try_variant_get(v, "$.hwids", "variant").isNotNull() & F.try_variant_get(v, "$.hwids", "array<variant>").isNull(), F.lit(None).cast("int")).otherwise(hwids)
    value = lambda x, name, kind, absent: F.when(x[name].isNull(), F.lit(absent).cast(kind)).otherwise(x[name].try_cast(kind))
    number = lambda x: value(x, "part_num", "int", 1)
    wrong = lambda x: x.isNull() | number(x).isNull() | functools.reduce(Column.__or__, (_is_nested(x[n]) for n in [*PART_TEXTS, "size_bytes"]))
    scalars = [*TEXTS, *LINKS, "zip_parts", "date_added", "enabled"]
    part = lambda x: F.struct(number(x).alias("part_num"), value(x, "filename", "string", "").alias("filename"), value(x, "size_bytes", "bigint", 0).alias("size_bytes"), value(x, "sha256", "string", "").alias("sha256"), value(x, "url", "string", "").alias("url"))
    reason = (
        F.when(~is_object, "no JSON object").when(F.coalesce(_get(v, "id", "string", ""), F.lit("")) == "", "missing id")
        .when(F.array_contains(F.array(*(_nested(v, n) for n in scalars)), True), "a list or object for a value").when(hwids.isNull(), "hwids not a list")
        .when(p.isNull() & ~listed, "parts not a list").when(p.isNull() | F.exists(p, wrong), "a bad part")
    )
    out = ours.select(
        "pos", "value", reason.alias("reason"), *(_get(v, n, "string", "").alias(c) for n, c in TEXTS.items()), hwids.alias("hwid_count"), _get(v, "zip_parts", "int", 1).alias("zip_parts"), _get(v, "date_added", "string", today).alias("date_added"),
        F.coalesce(_get(v, "enabled", "boolean", True), F.lit(False)).alias("enabled"), *(_get(v, n, "string", None).alias(n) for n in LINKS), F.transform(p, part).alias("parts"),
    )
    return out


def merge_parts(old: Column, new: Column) -> Column:
    """Parts by number: of those of one number the last; in order of number."""
    every = F.concat(F.coalesce(old, F.array().cast(f"array<{PART}>")), new)
    placed = F.array_sort(F.transform(every, lambda x, i: F.struct(x["part_num"].alias("n"), i.alias("i"), x.alias("x"))))
    pairs = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))  # each with the one after it
    last = F.filter(pairs, lambda z: z["b"].isNull() | (z["b"]["n"] != z["a"]["n"]))
    return F.transform(last, lambda z: z["a"]["x"])


def save(spark: SparkSession, path: str, items: DataFrame, today: str, buckets: int = snapshots.BUCKETS, file_bytes: int = snapshots.FILE_BYTES) -> None:
    """Put the good entries of ``items`` (pos, value: JSON text) into the store, and the bad ones aside.

    An entry replaces the one of its id; of repeated ids the last by pos counts. Parts replace those of their number and others stay, also parts of earlier
    repeats. Saving the same again changes nothing.
    """
    read = read_entries(items, today)
    held = cut(read.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value"))), "entries")  # the texts of good entries aren't needed again
    try:
        bad = held.where("reason IS NOT NULL").groupBy(F.sha2(F.coalesce("value", F.lit("")), 256).alias("digest")).agg(F.first("driver_id").alias("driver_id"), F.first("reason").alias("reason"), F.first("value").alias("value"))
        snapshots.upsert(spark, f"{path}/refused", bad, "digest", (), buckets, file_bytes)
        rows = scratch.cut(_one_an_id(held.where("reason IS NULL")), "rows")
    finally:
        release(held)  # of all parts there are two copies at a time, not three
    try:
        snapshots.upsert(spark, f"{path}/drivers", rows, "driver_id", (), buckets, file_bytes, {"parts": merge_parts})
    finally:
        release(rows)


def _one_an_id(good: DataFrame) -> DataFrame:
    """``COLUMNS`` of entries, one an id. Only entries of an id that comes again are dealt, with their parts; of the others the id alone."""
    twice = scratch.cut(good.groupBy("driver_id").count().where("count > 1").select("driver_id"), "repeated")
    single = good if twice.isEmpty() else good.join(twice, "driver_id", "left_anti")
    rows = single.withColumn("parts", merge_parts(F.lit(None), F.col("parts"))).select(*COLUMNS)
    if single is good:
        return rows
    last = [c for c in COLUMNS if c not in ("driver_id", "parts")]
    one = good.join(twice, "driver_id", "left_semi").groupBy("driver_id").agg(*(F.max_by(c, "pos").alias(c) for c in last), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "parts"))), lambda x: x["parts"])).alias("parts"))
    return rows.unionByName(one.withColumn("parts", merge_parts(F.lit(None), F.col("parts"))).select(*COLUMNS))


def drivers(spark: SparkSession, path: str) -> DataFrame | None:
    d = snapshots.read(spark, f"{path}/drivers")
    return d and d.drop("parts")


def parts(spark: SparkSession, path: str) -> DataFrame | None:
    """(driver_id, part_num, filename, size_bytes, sha256, url)"""
    d = snapshots.read(spark, f"{path}/drivers")
    return d and d.select("driver_id", F.inline("parts"))


def refused(spark: SparkSession, path: str) -> DataFrame | None:
    """(digest, driver_id, reason, value) of what was put aside."""
    return snapshots.read(spark, f"{path}/refused")
