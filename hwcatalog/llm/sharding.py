"""Shards of a reproducible shuffle: a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered in the order of doc_id, whatever the partitions. A permutation of 0 .. n - 1 that is known by n and a
seed alone sends row r to place p; shard p mod S and slot p div S follow. So shards differ by one row at most, slots have
no gaps, and for any (shard, slot) the row number is computed back without looking at any data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import scan
from .common import fresh, release

#: An odd number below 2**63 that spreads bits.
SPREAD = 0x6B74_7FDC_34B7_FEC9


class Permutation:
    """A permutation of 0 .. n - 1 by a Feistel network on pairs (l, r), l below a and r below b, where a * b is n or a little more.

    Rounds add a keyed hash of one half to the other, modulo a and b in turn. Whoever lands at n or above walks on through the
    same network until it is below n: fewer than a places lie above n, so walks are short.
    """

    def __init__(self, n: int, seed: int = 13, rounds: int = 8):
        if not 0 <= n < 2**62:
            raise ValueError("n must be at least 0 and below 2**62")
        self.n, self.rounds = n, rounds
        self.a = math.isqrt(max(n - 1, 0)) + 1
        self.b = max(1, -(-n // self.a))
        self.keys = np.random.default_rng(seed).integers(0, 2**63, (rounds, 2), dtype=np.uint64)
        self.keys[:, 0] |= np.uint64(1)

    def _hash(self, x: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = x * self.keys[k, 0] + self.keys[k, 1]
            return ((x ^ (x >> np.uint64(32))) * np.uint64(SPREAD)) >> np.uint64(33)

    def _step(self, v: np.ndarray, back: bool) -> np.ndarray:
        a, b = np.uint64(self.a), np.uint64(self.b)
        left, right = v // b, v % b
        for k in range(self.rounds)[:: -1 if back else 1]:
            if k % 2:
                h = self._hash(left, k) % b
                right = (right + (b - h if back else h)) % b
            else:
                h = self._hash(right, k) % a
                left = (left + (a - h if back else h)) % a
        return left * b + right

    def _walk(self, x, back: bool) -> np.ndarray:
        v = np.atleast_1d(np.asarray(x, np.int64))
        if v.size and (v.min() < 0 or v.max() >= self.n):
            raise ValueError(f"not in 0 .. {self.n - 1}")
        v = self._step(v.astype(np.uint64), back)
        while len(out := np.flatnonzero(v >= self.n)):
            v[out] = self._step(v[out], back)
        return v.astype(np.int64)

    def places(self, rows) -> np.ndarray:
        """Where rows go."""
        return self._walk(rows, back=False)

    def rows(self, places) -> np.ndarray:
        """Which rows are at places."""
        return self._walk(places, back=True)

    def row_at(self, shard, slot, shards: int) -> np.ndarray:
        """Which row is at a slot of a shard."""
        return self.rows(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def number_rows(docs: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of ``docs``, size, text_crc32 and row: global row numbers from 0, written to the shared folder.

    Rows are numbered by doc_id (null last), then by the text's CRC, size and 64-bit hash (a null text as an empty one), so the number doesn't
    depend on how rows were stored; rows alike in all of these are interchangeable and get numbers of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc, h, where, one = fresh(docs, "doc", "h", "where", "one")
    keys = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text), doc: F.col("doc_id").cast("long"), h: F.xxhash64(text), where: F.monotonically_increasing_id(), one: F.lit(1)}
    keyed = docs.select(*names, *(c.alias(n) for n, c in keys.items()))
    # where a row is stored comes last: it only lets rows that repeat one another be dealt to several tasks
    done = scan(keyed, [], [F.col(doc).asc_nulls_last(), "text_crc32", "size", h, where], {"row": ("sum", one)}, "numbered")
    out = done.withColumn("row", F.col("row") - 1).drop(doc, h, where, one)
    out._cut_path = done._cut_path
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 13, columns: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with size, text_crc32, row, shard and slot: its place in a reproducible shuffle.

    ``columns`` are the columns that are carried along, all by default; without text only numbers are shuffled. Size is the text's
    bytes plus 1; a null text counts as empty. Shards hold numbers of rows that differ by one at most, slots count from 0. Repeated
    rows have places of their own; rows without doc_id come last in the order that is permuted. An empty table gives an empty
    result. Columns of ``docs`` named as the new ones are left out.
    """
    mine = ("size", "text_crc32", "row", "shard", "slot")
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() not in mine]
    numbered = number_rows(docs, names)
    own = Permutation((numbered.agg(F.max("row")).first()[0] + 1) if not numbered.isEmpty() else 0, seed)

    @F.pandas_udf("long")
    def places(rows: pd.Series) -> pd.Series:
        return pd.Series(own.places(rows.to_numpy()))

    (place,) = fresh(numbered, "place")
    out = numbered.withColumn(place, places("row"))
    return out.withColumns({"shard": F.col(place).cast("long") % shards, "slot": F.expr(f"{place} div {shards}")}).withColumn("shard", F.col("shard").cast("int")).drop(place)


def shard_table(docs: DataFrame, shards: int = 8, seed: int = 13) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs``; see ``shard``.

    The law is ``rows``: counts differ by one at most. grown_shard belongs to another law and is null.
    """
    out = shard(docs, shards, seed, ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 13, rows_per_file: int = 100_000) -> None:
    """Write ``docs`` as Parquet: a folder ``shard=k`` for each shard, and in it a file for each run of slots, sorted by slot.

    The columns of ``shard`` are added. A file's range of slots is in its Parquet statistics, so a reader of one slot needs one file.
    """
    placed = shard(docs, shards, seed)
    files = shards * max(1, math.ceil(placed.count() / shards / rows_per_file))
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    release(placed)
