"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size S is wanted t / S times on average. The whole part of that
is given to every document; the fractional part is a probability, and the probabilities of a source are
rounded to 0 or 1 dependently: two documents are paired and mass (probability times words) moves
between them, to one side or the other at random, until one of them is integral. A move keeps the
pair's mass, and keeps each document's probability on average. One document stays fractional; the
fractional rests of small groups are paired again in larger groups, level by level in a reduction
tree, until a source has one, which is rounded last. So the words taken from a source miss its
target by less than one document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCS, WORD, cut, fresh, release


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of each source of ``sized`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share all words; a target stops at ``most``
    times its source's size, and the excess is shared anew by weight among the others until none is above.
    One row a source is gathered by partial sums; the shares are found by repeated sums over those rows.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # one small row a source is ranked in one task; documents never are
    ranked = by.withColumn("_null", F.col("source").isNull())
    table = ", ".join(map(str, weights))
    ranked = ranked.selectExpr("source", "source_size", f"element_at(array({table}), cast((row_number() over (order by _null, source) - 1) % {len(weights)} + 1 as int)) as w")
    ranked = cut(ranked, "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    num, den = total, ranked.agg(F.sum("w")).first()[0] or 1
    while True:  # num / den words for each unit of weight; a source is capped if its share is above its stop
        capped = F.col("w") * F.lit(num).cast("decimal(38,0)") > F.col("source_size") * F.lit(most) * F.lit(den).cast("decimal(20,0)")
        row = ranked.agg(F.sum(F.when(capped, F.col("source_size") * most).otherwise(0)).alias("c"), F.sum(F.when(capped, 0).otherwise(F.col("w"))).alias("w")).first()
        n, d = total - (row.c or 0), row.w or 0
        if not d or (n, d) == (num, den):
            break
        num, den = n, d
    target = F.when(capped, (F.col("source_size") * most).cast("double")).otherwise((F.col("w").cast("long") * F.lit(num)).cast("double") / F.lit(den))
    return ranked.select("source", "source_size", target.alias("target"))


def _round_group(pdf: pd.DataFrame, *, final: bool) -> pd.DataFrame:
    """Pair the rows of a group, in the order of ``turn``, until at most one is fractional (none if ``final``)."""
    pdf = pdf.sort_values(["turn", "row_key"], kind="stable").reset_index(drop=True)
    p, size = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
    draws = np.random.default_rng([int(pdf["seed"].iloc[0]) & 0x7FFFFFFFFFFFFFFF]).random(len(pdf) + 1)
    held, eps = -1, 1e-12
    for k in range(len(p)):
        if p[k] <= eps or p[k] >= 1 - eps:
            p[k] = round(p[k])
            continue
        if held < 0:
            held = k
            continue
        a, b = held, k
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # mass that a can gain from b
        down = min(p[a] * size[a], (1 - p[b]) * size[b])  # mass that b can gain from a
        move = up if draws[k] * (up + down) < down else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        ra, rb = (x if eps < x < 1 - eps else round(x) for x in (p[a], p[b]))
        p[a], p[b] = ra, rb
        held = a if 0 < ra < 1 else b if 0 < rb < 1 else -1
    if final and held >= 0:
        p[held] = float(draws[-1] < p[held])
    return pdf.assign(p=p)[["row_key", "source", "size", "p"]]


def _round_some(pdf: pd.DataFrame) -> pd.DataFrame:
    return _round_group(pdf, final=False)


def _round_last(pdf: pd.DataFrame) -> pd.DataFrame:
    return _round_group(pdf, final=True)


def pivotal_round(rows: DataFrame, seed: int = 0, group: int = 5000) -> DataFrame:
    """``rows`` (row_key long, source, size long, p double in [0, 1]) with p rounded to 0 or 1 within each source.

    Groups are set by hashes of row_key, not by partitions, so reruns agree. A group has about ``group`` rows at
    every level, however large its source; only rows that are still fractional go to the next level.
    """
    columns = ["row_key", "source", "size", "p"]
    schema = "row_key long, source string, size long, p double"
    done, left, level = [], rows.select(*columns), 0
    while True:
        counts = cut(left.groupBy("source").agg(F.ceil(F.count("*") / group).cast("long").alias("groups")), "groups")
        last = counts.agg(F.max("groups")).first()[0] or 1
        level += 1
        keyed = left.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("row_key", F.lit(seed + level)), F.col("groups")))
        keyed = keyed.select(*columns, F.xxhash64("row_key", F.lit(seed + 1000 + level)).alias("turn"), F.xxhash64("source", "bucket", F.lit(seed + 2000 + level)).alias("seed"), "bucket")
        final = last == 1
        out = cut(keyed.groupBy("source", "bucket").applyInPandas(_round_last if final else _round_some, schema), "rounded")
        release(counts)
        if final:
            return _union([*done, out])
        done.append(out.where("p IN (0D, 1D)"))
        left = out.where("p NOT IN (0D, 1D)")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """How often each document is taken: doc_id, source, row_key, size, source_size, target, copies, taken.

    ``docs`` needs doc_id, source and text. Size is the number of words of the whole text (null: 0); taken is copies
    times size. Documents without words are never taken. Rows are told apart by doc_id, source and text together;
    rows that repeat all three share one decision, so reruns agree and a repeated row is taken as often as the first.
    An empty table gives an empty result. A null source is a source of its own, last in order.
    """
    size = F.coalesce(F.size(F.expr(f"regexp_extract_all(text, r'({WORD})', 1)")), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")).alias("row_key"), size.alias("size")), "sized", rows=docs.count(), per_file=DOCS)
    targets = source_targets(sized, weights, most).withColumnRenamed("source", "_s")
    wanted = cut(sized.join(targets, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("wanted", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)), "wanted")
    part = F.col("wanted") - F.floor("wanted")
    # repeats of a row are one unit of its size times their number
    units = wanted.where("size > 0").groupBy("row_key", "source").agg(F.sum("size").alias("size"), F.first(part).alias("p"))
    extra = pivotal_round(units, seed).select(F.col("row_key").alias("_k"), F.col("source").alias("_s"), F.col("p").cast("long").alias("extra"))
    out = wanted.join(extra, (F.col("row_key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_k", "_s")
    copies = F.when(F.col("size") > 0, F.floor("wanted").cast("long") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "source", "row_key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with every row repeated as often as ``mix`` takes it; rows taken never are left out."""
    names = docs.columns
    key, own, copies, copy = fresh(docs, "key", "own", "copies", "copy")
    times = mix(docs.select("doc_id", "source", "text"), **params).select(F.col("row_key").alias(key), F.col("copies").alias(copies)).where(F.col(copies) > 0).dropDuplicates([key])
    keyed = docs.withColumn(own, F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")))
    return keyed.join(times, F.col(own) == F.col(key)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*names)
