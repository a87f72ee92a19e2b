"""Exact greedy packing of an ordered list, by many tasks.

Where a bin ends depends on all bins before it. What doesn't: the bin that would begin at an entry, so where the next one begins. That
successor is the same for whoever asks, and is found for all entries at once by laying each entry's limit into the sorted running sums.
Then blocks of consecutive entries are contracted, each to a map from its entries to the first successor beyond the block; the
few entries so reached jump from block to block by pointer doubling; and each block is walked again from the one entry where the packing enters it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, release
from .scans import scan

#: Entries of a block, which is walked in one task.
BLOCK = 50_000
_GROUP = ["g1", "g2"]


def _named(group: str) -> list[Column]:
    """128 bits that stand for a group's name, null apart."""
    c = F.col(group)
    return [F.when(c.isNull(), 0).otherwise(F.xxhash64(c)).cast("long").alias("g1"), F.when(c.isNull(), 1).otherwise(F.xxhash64(F.lit(7), c)).cast("long").alias("g2")]


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """(g1, g2, idx, out): for each entry of a block the first entry beyond the block that bins from there on begin at."""
    pdf = pdf.sort_values("idx")
    idx, nxt = pdf["idx"].to_numpy(), pdf["nxt"].to_numpy()
    first, end = idx[0], idx[-1]
    out = nxt.copy()
    for k in range(len(idx) - 1, -1, -1):
        if nxt[k] <= end:
            out[k] = out[nxt[k] - first]
    return pd.DataFrame({"g1": pdf["g1"], "g2": pdf["g2"], "idx": idx, "out": out})


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """(g1, g2, idx, opens): whether a bin begins at an entry of the block, from the one where the packing enters."""
    pdf = pdf.sort_values("idx")
    idx, nxt = pdf["idx"].to_numpy(), pdf["nxt"].to_numpy()
    opens = np.zeros(len(idx), np.int64)
    at = pdf["entry"].min()  # NaN where one long bin passes over the whole block
    while at == at and at <= idx[-1]:
        opens[int(at - idx[0])] = 1
        at = nxt[int(at - idx[0])]
    return pd.DataFrame({"g1": pdf["g1"], "g2": pdf["g2"], "idx": idx, "opens": opens})


def greedy_bins(items: DataFrame, group: str, order: list[str], caps: dict[str, int | Column], block: int = BLOCK) -> DataFrame:
    """``items`` with bin (int, from 0 in each group): entries fill bins in order; one opens a new bin where any sum of the bin would pass its cap.

    ``caps`` names columns of whole numbers, at least 0 (null: 0), and the most that a bin may hold of each; an entry above a cap has a bin of its own. Equal to
    a loop over the group's entries, but no task sees more than a range of rows or a block of ``block`` entries. Rows that tie in
    ``order`` come in any order; a null group is a group. An empty table gives an empty result.
    """
    names = items.columns
    sizes = {f"_size{i}": c for i, c in enumerate(caps)}
    limits = {f"_cap{i}": cap if isinstance(cap, Column) else F.lit(cap) for i, cap in enumerate(caps.values())}
    rows = items.select(F.struct(*names).alias("_item"), *_named(group), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(order)), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(s) for s, c in sizes.items()), *(v.cast("long").alias(k) for k, v in limits.items()), F.lit(1).alias("_one"))
    by = [F.col(f"_by{i}").asc_nulls_first() for i in range(len(order))]
    placed = scan(rows, _GROUP, [*by, F.monotonically_increasing_id()], {"_n": ("sum", "_one"), **{f"_sum{i}": ("sum", s) for i, s in enumerate(sizes)}}, "packing")
    entries = placed.withColumn("idx", F.col("_n") - 1)
    # the next bin's first entry: how many entries end within this entry's limit
    nxt = None
    for i in range(len(sizes)):
        ends = entries.select(*_GROUP, F.col(f"_sum{i}").alias("value"), F.lit(0).alias("asks"), "idx", F.lit(1).alias("one"))
        asks = entries.select(*_GROUP, (F.col(f"_sum{i}") - F.col(f"_size{i}") + F.col(f"_cap{i}")).alias("value"), F.lit(1).alias("asks"), "idx", F.lit(0).alias("one"))
        laid = scan(ends.union(asks), _GROUP, ["value", "asks", "idx"], {"within": ("sum", "one")}, "limits")
        mine = laid.where("asks = 1").select(*_GROUP, "idx", F.greatest(F.col("idx") + 1, "within").alias("nxt"))
        nxt = mine if nxt is None else nxt.unionByName(mine)
    nxt = nxt.groupBy(*_GROUP, "idx").agg(F.min("nxt").alias("nxt"))
    nxt = cut(nxt.withColumn("block", F.expr(f"idx div {block}")), "next")
    entered = _entered(nxt, block)
    walked = nxt.join(entered, [*_GROUP, "block"], "left").groupBy(*_GROUP, "block").applyInPandas(_walk, "g1 long, g2 long, idx long, opens long")
    bins = scan(walked, _GROUP, ["idx"], {"bin": ("sum", "opens")}, "bins").select(*_GROUP, "idx", (F.col("bin") - 1).cast("int").alias("bin"))
    release(nxt)
    return entries.select(*_GROUP, "idx", "_item").join(bins, [*_GROUP, "idx"]).select("_item.*", "bin")


def _entered(nxt: DataFrame, block: int) -> DataFrame:
    """(g1, g2, block, entry): the entry at which the packing from entry 0 on comes into each block that it doesn't pass over."""
    start = nxt.where("idx = 0").select(*_GROUP, F.col("idx").alias("entry"))
    if nxt.where("block > 0").isEmpty():
        return start.select(*_GROUP, F.lit(0).cast("long").alias("block"), "entry")
    out = cut(nxt.groupBy(*_GROUP, "block").applyInPandas(_contract, "g1 long, g2 long, idx long, out long"), "contracted")
    # only entries that some block leads to, and the first, can be entered
    reached = out.select(*_GROUP, F.col("out").alias("idx")).union(start.withColumnRenamed("entry", "idx")).distinct()
    first = cut(out.join(reached, [*_GROUP, "idx"]), "jump")
    release(out)
    nodes = first.select(*_GROUP, F.col("idx").alias("entry"))
    seen, jump = cut(start, "entered"), first
    while True:  # seen holds the entries of the first 2**k blocks that are entered, jump leads 2**k of them on
        more = seen.join(jump.withColumnRenamed("idx", "entry"), [*_GROUP, "entry"]).select(*_GROUP, F.col("out").alias("entry"))
        step = cut(seen.union(more.join(nodes, [*_GROUP, "entry"], "left_semi")).distinct(), "entered")
        done = step.count() == seen.count()
        release(seen)
        seen = step
        if done:
            for t in {id(t): t for t in (first, jump)}.values():
                release(t)
            return seen.select(*_GROUP, F.expr(f"entry div {block}").alias("block"), "entry")
        further = cut(jump.join(jump.select(*_GROUP, F.col("idx").alias("out"), F.col("out").alias("far")), [*_GROUP, "out"]).select(*_GROUP, "idx", F.col("far").alias("out")), "jump")
        if jump is not first:
            release(jump)
        jump = further
