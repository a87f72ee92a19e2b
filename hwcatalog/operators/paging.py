"""Pages of a table in a fixed order: numbered in one pass, or stored in that order so that any page costs the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import scan

#: Rows of a range of a stored table.
PER_RANGE = 5000


def numbered(rows: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """``rows`` with their number from 1 in an order. Ranges of the order are counted by different tasks; rows that tie come in any order."""
    one = "_" * (1 + max([0, *(len(c) - len(c.lstrip("_")) for c in rows.columns)])) + "one"
    return scan(rows.withColumn(one, F.lit(1)), [], order, {name: ("sum", one)}, "numbered").drop(one)


def pages(rows: DataFrame, order: list[str | Column], size: int) -> DataFrame:
    """All pages of ``rows`` in one pass: ``rows`` with page and n, from 1."""
    return numbered(rows, order).withColumn("page", F.expr(f"cast((n - 1) div {size} + 1 as int)"))


def store(rows: DataFrame, path: str, order: list[str | Column], per_range: int = PER_RANGE) -> None:
    """Write ``rows`` as Parquet in an order, with their number n from 1: a folder for each ``per_range`` rows, sorted by n."""
    placed = numbered(rows, order).withColumn("range", F.expr(f"(n - 1) div {per_range}"))
    placed.repartition("range").sortWithinPartitions("range", "n").write.partitionBy("range").parquet(path)


def page(spark: SparkSession, path: str, number: int, size: int, per_range: int = PER_RANGE, after: int | None = None) -> DataFrame:
    """A page of what ``store`` wrote, in order: the ``number``-th of ``size`` rows, or the ``size`` rows after the one numbered ``after``, a cursor that the page before ended with.

    Only the folders that hold the page are read, so the last page costs what the first does.
    """
    first = (number - 1) * size + 1 if after is None else after + 1
    last = first + size - 1
    ranges = list(range((first - 1) // per_range, (last - 1) // per_range + 1))
    return spark.read.parquet(path).where(F.col("range").isin(ranges) & F.col("n").between(first, last)).drop("range").orderBy("n")
