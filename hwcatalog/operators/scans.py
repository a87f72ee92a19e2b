"""Running sums, parities and last values along a sorted table, exact however long a segment is.

The table is range-partitioned and sorted once, so a segment of any length is spread over as many tasks as it
needs. Every task runs over its own rows as if nothing came before; one small row a task then says what the next task must add
to the segment that goes on there. Nothing but those rows, as many as there are partitions, reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut


def _accumulate(op: str, x: np.ndarray, new: np.ndarray, before):
    """Running values of one batch: ``new`` marks where a segment starts, ``before`` is the value up to the batch (None: nothing yet)."""
    k = np.arange(len(x))
    start = np.maximum.accumulate(np.where(new, k, -1))  # -1: the segment began before this batch
    if op == "last":  # NaN-free: x holds (value, known)
        value, known = x[:, 0], x[:, 1] != 0
        at = np.maximum.accumulate(np.where(known, k, -1))
        own = (at >= start) & (at >= 0)
        out, has = np.where(own, value[at], 0), own.copy()
        if before is not None:
            lead = (start < 0) & ~own
            out[lead], has[lead] = before, True
        return out, has
    with np.errstate(over="ignore"):
        if op == "sum":
            run = np.cumsum(x)
            out = run - np.where(start > 0, run[start - 1], 0)
            return (out + np.where(start < 0, before or 0, 0), None)
        run = np.bitwise_xor.accumulate(x)
        out = run ^ np.where(start > 0, run[start - 1], 0)
        return (out ^ np.where(start < 0, before or 0, 0), None)


def scan(df: DataFrame, segment: list[str], order: list[str | Column], values: dict[str, tuple[str, str]], what: str = "scan", parts: int | None = None) -> DataFrame:
    """``df`` with one more long column for each entry of ``values``: name -> (operation, long column), taken from the first row of the segment to the row itself.

    Rows are sorted by ``segment`` (long columns without nulls; none: the table is one segment), then ``order``; rows that tie in both come in any
    order. Operations: ``sum`` and ``xor`` (nulls count as 0), and ``last``, the last value that isn't null. The result is written to the shared
    folder. An empty table gives an empty result; columns of ``df`` may have any names but those of ``values``.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead = "_" * (1 + max([0, *(len(c) - len(c.lstrip("_")) for c in df.columns)]))  # names that df can't have
    part, at, head, mid = (f"{lead}{n}" for n in ("part", "at", "head", "mid"))
    locals_ = {n: f"{mid}{i}" for i, n in enumerate(values)}
    by = [F.col(s) for s in segment] + [F.col(o) if isinstance(o, str) else o for o in order]
    # columns that an Arrow batch needs as plain numbers
    ready = df.withColumns({locals_[n]: F.col(c).cast("long") if op == "last" else F.coalesce(F.col(c).cast("long"), F.lit(0)) for n, (op, c) in values.items()})
    ready = (ready.repartitionByRange(parts, *by) if by else ready).sortWithinPartitions(*by)
    names, ops = ready.columns, {locals_[n]: op for n, (op, _) in values.items()}

    def run(batches):
        task, row, seg, only, state = TaskContext.get().partitionId(), 0, None, True, dict.fromkeys(ops)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(names.index(s)).to_numpy(zero_copy_only=False) for s in segment] or [np.zeros(n, np.int64)])
            new = np.ones(n, bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            new[0] = seg is None or bool((keys[:, 0] != seg).any())
            later = new.copy()
            later[0] &= seg is not None
            heads = only & (np.cumsum(later) == 0)
            columns = {c: batch.column(i) for i, c in enumerate(names)}
            for c, op in ops.items():
                if op == "last":
                    raw = columns[c]
                    x = np.stack([raw.fill_null(0).to_numpy(zero_copy_only=False), raw.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
                else:
                    x = columns[c].to_numpy(zero_copy_only=False)
                out, has = _accumulate(op, x, new, state[c])
                columns[c] = pa.array(out, pa.int64(), mask=None if has is None else ~has)
                state[c] = int(out[-1]) if has is None or has[-1] else None
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(n, task), pa.int64()), pa.array(np.arange(row, row + n)), pa.array(heads)], names=[*names, part, at, head])
            row, seg, only = row + n, keys[:, -1].copy(), bool(heads[-1])

    schema = T.StructType([*ready.schema.fields, T.StructField(part, T.LongType()), T.StructField(at, T.LongType()), T.StructField(head, T.BooleanType())])
    done = cut(ready.mapInArrow(run, schema), what)
    ends = F.struct(*segment, *ops) if segment or ops else F.lit(0)
    edges = done.groupBy(part).agg(F.min_by(F.struct(*segment) if segment else F.lit(0), at).alias("first"), F.max_by(ends, at).alias("last"), F.bool_and(head).alias("one")).collect()  # a row a partition
    carry, rows, known = None, [], None
    for e in sorted(edges, key=lambda r: r[part]):
        mine = tuple(e["first"]) if segment else ()
        into = carry if known == mine else None
        if into is not None:
            rows.append((e[part], *into))
        last = [e["last"][c] for c in ops]
        if e["one"] and into is not None:
            last = [_join(op, i, x) for op, i, x in zip(ops.values(), into, last, strict=True)]
        carry, known = last, tuple(e["last"][s] for s in segment)
    out = done
    if rows:
        more = spark.createDataFrame(rows, T.StructType([T.StructField(f"{part}s", T.LongType()), *(T.StructField(f"{c}c", T.LongType()) for c in ops)]))
        out = out.join(F.broadcast(more), (F.col(part) == F.col(f"{part}s")) & F.col(head), "left")  # at most a row a partition
        final = {"sum": lambda c: F.col(c) + F.coalesce(F.col(f"{c}c"), F.lit(0)), "xor": lambda c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"{c}c"), F.lit(0))), "last": lambda c: F.coalesce(F.col(c), F.col(f"{c}c"))}
    else:
        final = dict.fromkeys(("sum", "xor", "last"), F.col)
    out = out.select(*df.columns, *(final[op](locals_[n]).alias(n) for n, (op, _) in values.items()))
    out._cut_path = done._cut_path
    return out


def _join(op: str, before, x):
    if op == "last":
        return before if x is None else x
    return (before or 0) + (x or 0) if op == "sum" else (before or 0) ^ (x or 0)
