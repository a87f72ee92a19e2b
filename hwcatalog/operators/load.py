"""Loading manifests into tables: validation, rows, upserts, clean-up, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import literals
from ..functions.hwid import is_generic
from ..functions.ids import display_name
from .packing import greedy_bins

# fixed values: the columns of the store's tables
DRIVER_COLUMNS = "driver_id pack driver_type provider category version arch display_name descriptions os_targets primary_url zip_parts date_added enabled supersedes superseded_by notes source_manifest updated_at".split()
HWID_COLUMNS = "hwid_string driver_id is_generic".split()
PART_COLUMNS = "driver_id part_num filename size_bytes sha256 url".split()


def reject_reason(items: DataFrame) -> DataFrame:
    """``items`` (value: an entry's JSON text) with why it can't be loaded, or null: no id, or hwids that aren't a list."""
    ident, hw = F.get_json_object("value", "$.id"), F.get_json_object("value", "$.hwids")
    return items.withColumn("reject_reason", F.when(F.coalesce(ident, F.lit("")) == "", "missing id").when(hw.isNotNull() & ~F.startswith(hw, F.lit("[")), "hwids not a list"))


def valid_parts(parts: Column) -> Column:
    return F.filter(parts, lambda p: p.isNotNull() & (F.coalesce(p["filename"], F.lit("")) != "") & (F.coalesce(p["url"], F.lit("")) != ""))


def enabled(value: Column, force: bool = False) -> Column:
    """Absent or null is enabled."""
    return F.lit(True) if force else F.coalesce(value, F.lit(True))


def since(date_added: Column, low: str | None) -> Column:
    """Dates from ``low`` on, compared as text; entries without a date always."""
    return F.lit(True) if low is None else F.coalesce(F.substring(date_added, 1, 10) >= low[:10], F.lit(True))


def driver_rows(items: DataFrame, force_enabled: bool = False) -> DataFrame:
    """Table rows of manifest items (file, d)."""
    d = lambda n: F.col(f"d.{n}")
    return items.select(
        d("id").alias("driver_id"), d("pack").alias("pack"), d("type").alias("driver_type"), d("provider").alias("provider"), d("category").alias("category"), d("version").alias("version"), d("arch").alias("arch"),
        display_name(d("descriptions"), d("provider"), d("category"), d("version"), d("id")).alias("display_name"), F.coalesce(d("descriptions"), F.array().cast("array<string>")).alias("descriptions"),
        F.coalesce(d("os_targets"), F.array().cast("array<string>")).alias("os_targets"), d("zip").alias("primary_url"), F.coalesce(d("zip_parts"), F.lit(0)).alias("zip_parts"), d("date_added").alias("date_added"),
        enabled(d("enabled"), force_enabled).alias("enabled"), d("supersedes").alias("supersedes"), d("superseded_by").alias("superseded_by"), d("notes").alias("notes"), F.col("file").alias("source_manifest"),
    )


def hwid_rows(items: DataFrame) -> DataFrame:
    return items.select(F.explode("d.hwids").alias("hwid_string"), F.col("d.id").alias("driver_id")).where("coalesce(hwid_string, '') <> ''").distinct().withColumn("is_generic", is_generic(F.col("hwid_string")))


def part_rows(items: DataFrame) -> DataFrame:
    return items.select(F.col("d.id").alias("driver_id"), F.explode(valid_parts(F.col("d.parts"))).alias("p")).select("driver_id", "p.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "driver_id", keep: tuple[str, ...] = ("created_at",), merged: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns in ``keep`` stay as they were where a row was there. New rows are one a key.

    A column in ``merged`` becomes that function of its old and new value where there is a new row.
    """
    n = new.alias("n")
    both = old.alias("o").join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"n.{key}").isNotNull()
    put = lambda c: merged[c](F.col(f"o.{c}"), F.col(f"n.{c}")) if merged and c in merged else F.col(f"n.{c}")
    pick = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) if c in keep or c == key else F.when(there, put(c)).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return both.select(*pick)


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame, key: str = "driver_id") -> DataFrame:
    """Children of touched parents are replaced as a whole."""
    return old.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def orphans(live: DataFrame, valid: DataFrame) -> DataFrame:
    """Live (driver_id, source_manifest) pairs that no valid pair backs."""
    return live.join(valid.select("driver_id", "source_manifest").distinct(), ["driver_id", "source_manifest"], "left_anti")


def counters(rows: DataFrame) -> DataFrame:
    """One row of load counters from tagged rows (status, null_enabled, hwids)."""
    return rows.agg(
        F.count("*").alias("seen"), F.count_if(F.col("status") == "ok").alias("upserted"), F.count_if(F.col("status") == "filtered").alias("filtered"), F.count_if(F.col("status") == "rejected").alias("skipped"),
        F.count_if("null_enabled").alias("null_enabled"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("hwids"))), F.lit(0)).alias("hwids_upserted"),
    )


REPORT = "driver_id string, status string, error string, bytes long"
REPORT_SUMMARY = "generated_at string, total long, completed long, failed long, skipped long, downloaded_bytes long"


def write_report(run: DataFrame, path: str, generated_at: str) -> None:
    """A run's report as JSON: ``<path>/drivers`` with a row a driver (driver_id, status, error, bytes), ``<path>/summary`` with one row of totals.

    The status is completed, failed or skipped; any other counts in the total alone. A report there already is replaced.
    """
    run.select("driver_id", "status", "error", "bytes").write.mode("overwrite").json(f"{path}/drivers")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = run.sparkSession.read.schema(REPORT).json(f"{path}/drivers")
    total = rows.agg(F.count("*").alias("total"), n("completed"), n("failed"), n("skipped"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("downloaded_bytes"))
    total.select(F.lit(generated_at).alias("generated_at"), "*").write.mode("overwrite").json(f"{path}/summary")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The drivers and the summary of a written report."""
    return spark.read.schema(REPORT).json(f"{path}/drivers"), spark.read.schema(REPORT_SUMMARY).json(f"{path}/summary")


def statements(drivers: DataFrame, hwids: DataFrame, parts: DataFrame) -> DataFrame:
    """(driver_id, source_manifest, n, bytes, value) per driver: its upsert, and its ids and parts deleted and put in anew, a statement a line.

    Columns that ``drivers`` lacks are null. A driver's statements stay together, so that a retry finds no half of them.
    """
    d = drivers.select(*(F.col(c) if c in drivers.columns else F.lit(None).cast("string").alias(c) for c in DRIVER_COLUMNS))
    rows = lambda t, table, columns, order: t.select("driver_id", F.struct(*order, literals.insert(t, table, columns).alias("s")).alias("r")).groupBy("driver_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["s"]).alias("s"))
    h = rows(hwids, "HWIDs", HWID_COLUMNS, ["hwid_string"]).withColumnRenamed("s", "h")
    p = rows(parts, "DriverParts", PART_COLUMNS, ["part_num", "filename"]).withColumnRenamed("s", "p")
    own = d.select("driver_id", "source_manifest", literals.upsert(d, "Drivers", DRIVER_COLUMNS, "driver_id").alias("u"), literals.delete(d, "HWIDs", "driver_id").alias("dh"), literals.delete(d, "DriverParts", "driver_id").alias("dp"))
    none = F.array().cast("array<string>")
    every = F.concat(F.array("u", "dh"), F.coalesce("h", none), F.array("dp"), F.coalesce("p", none))
    out = own.join(h, "driver_id", "left").join(p, "driver_id", "left").select("driver_id", "source_manifest", every.alias("all"))
    text = F.concat(F.array_join("all", "\n"), F.lit("\n"))
    return out.select("driver_id", "source_manifest", F.size("all").alias("n"), F.octet_length(text).alias("bytes"), text.alias("value"))


def chunk_texts(blocks: DataFrame, batch: int = 5000, max_bytes: int = 40_000_000) -> DataFrame:
    """(source_manifest, chunk, value): the files of ``statements`` in order of driver_id, each of bounded size."""
    order = blocks.select("source_manifest", F.col("driver_id").alias("pos"), "n", "bytes")
    placed = chunks(order, batch, max_bytes).withColumnRenamed("pos", "driver_id")
    rows = blocks.join(placed, ["source_manifest", "driver_id"])
    by = rows.groupBy("source_manifest", "chunk").agg(F.sort_array(F.collect_list(F.struct("driver_id", "value"))).alias("v"))
    return by.select("source_manifest", "chunk", F.array_join(F.transform("v", lambda x: x["value"]), "").alias("value"))


def chunks(statements: DataFrame, batch: int, max_bytes: int) -> DataFrame:
    """(source_manifest, pos, chunk) for blocks (source_manifest, pos, n, bytes): a chunk closes before the block that would reach ``batch`` statements or ``max_bytes``.

    A block at or above a limit has a chunk of its own. Where chunks end is found by many tasks, however many blocks a manifest has.
    """
    out = greedy_bins(statements.select("source_manifest", "pos", "n", "bytes"), "source_manifest", ["pos"], {"n": batch - 1, "bytes": max_bytes - 1})
    return out.select("source_manifest", "pos", F.col("bin").alias("chunk"))


def guard_never_shrink(before: int, added: int, after: int) -> None:
    """Refuse a save that would lose entries; all entries count, enabled or not."""
    if after < before + added:
        raise ValueError(f"the catalog would shrink: {before} and {added} new, {after} after")
