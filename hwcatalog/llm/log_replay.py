"""Reassembly of an interleaved transaction log, by two secondary sorts of RDDs and state machines over their partitions.

First sort: (source, doc_id), latest record first. Read backwards, the fate of a change is known when it is met: the state is
only how its transaction ends and how many later rollbacks are still open, where a savepoint closes one. A change under open rollbacks is
undone by the nearest of them, which a further sort by (transaction, number open, doc_id) puts right before it.

Second sort: (key, commit, doc_id). A version that follows another of its key changes the store by the difference to that one, so the
deltas stream past with one version in memory; they are summed by epoch, and a running sum over epochs gives the states.

Sorts are by ranges of the whole key, so a source, transaction or key that holds a third of the log goes to many tasks. A task
first tells how it changes a state that comes into it, in a few numbers whatever it holds (a count that can't
fall below 0 changes by x -> max(a, x + b)); these are put together from task to task, then all tasks run.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import scan
from .common import cut, release

#: Kinds of log records.
CHANGE, COMMIT, ABORT, SAVEPOINT, ROLLBACK = range(5)
#: Sampled keys a partition, from which the ranges of a sort are taken.
SAMPLED = 40


def secondary_sort(rows: RDD, n: int, parts: int) -> RDD:
    """``rows`` (key, value), about ``n`` of them, dealt to ranges of the key and sorted by key within; keys are tuples that compare with each other.

    Ranges come from a sample of a fixed number of keys a partition. Only rows with equal whole keys must meet.
    """
    sample = sorted(rows.keys().sample(False, min(1.0, SAMPLED * parts / max(n, 1)), 17).collect())
    bounds = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    return rows.repartitionAndSortWithinPartitions(parts, lambda k: bisect_right(bounds, k))


def log_of(docs: DataFrame, labels: DataFrame, keys: int = 300) -> DataFrame:
    """Log records (lsn, source, kind, key, value, tie) of ``docs`` (doc_id, source, text): value is crc32(key:text), null for a deletion.

    With h = crc32(doc_id): h mod 23 of 0 to 1 is a commit, 2 an abort, 3 to 4 a savepoint, 5 to 6 a rollback, any other a change of key
    floor(h / 100) mod ``keys``. A null text, or toxic 1 in a row of ``labels``, deletes. Rows without doc_id are no log records. tie orders rows of one doc_id and source.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    m = F.pmod(h, F.lit(23))
    kind = F.when(m < 2, COMMIT).when(m < 3, ABORT).when(m < 5, SAVEPOINT).when(m < 7, ROLLBACK).otherwise(CHANGE)
    key = F.expr("h div 100") % keys
    slim = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("lsn"), F.col("source").cast("string").alias("source"), kind.alias("kind"), h.alias("h"), "text")
    slim = slim.withColumn("key", key).select("lsn", "source", "kind", F.when(F.col("kind") == CHANGE, F.col("key")).alias("key"), F.when(F.col("kind") == CHANGE, F.crc32(F.concat(F.col("key").cast("string"), F.lit(":"), "text"))).alias("value"), F.xxhash64("text").alias("tie"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("lsn"), F.lit(True).alias("toxic")).distinct()
    both = slim.join(toxic.hint("merge"), "lsn", "left")  # never broadcast: labels grow with the log
    return both.select("lsn", "source", "kind", "key", F.when(F.col("toxic").isNull(), F.col("value")).alias("value"), "tie")


def _source(x: str | None) -> tuple:
    return (0, "") if x is None else (1, x)


def fates(log: DataFrame, parts: int) -> DataFrame:
    """(what, source, end, level, lsn, key, value, tie): what is c (committed by the record ``end``), a (aborted by it; null: the log's end), u (undone by the rollback of
    ``level`` open ones that comes next) for changes, and r for rollbacks, with the level they open."""
    rows = log.rdd.map(lambda r: ((_source(r.source), -r.lsn, -(r.tie or 0), -r.kind), (r.key, r.value)))
    rows = secondary_sort(rows, log.count(), parts)

    def summary(i, records):
        first = last = end = None
        alone, a, b = True, 0, 0
        for (source, lsn, _, kind), _ in records:
            if source != last:
                alone, first = last is None, first or source
                last, end, a, b = source, None, 0, 0
            kind = -kind
            if kind in (COMMIT, ABORT):
                end, a, b = (kind, -lsn), 0, 0
            elif kind == ROLLBACK:
                a, b = a + 1, b + 1
            elif kind == SAVEPOINT:
                a, b = max(0, a - 1), b - 1
        if last is not None:
            yield i, first, last, alone, end, a, b

    into, state, source = {}, (None, 0), None
    for i, first, last, alone, end, a, b in sorted(rows.mapPartitionsWithIndex(summary).collect()):  # a row a partition
        if first != source:
            state = (None, 0)
        elif state != (None, 0):
            into[i] = (first, *state)
        kept = state if alone else (None, 0)
        # after a transaction's end the count starts anew, so what came in no longer matters
        state = (end, max(a, b)) if end else (kept[0], max(a, kept[1] + b))
        source = last

    def run(i, records):
        source, end, level = into.get(i, (None, None, 0))
        for (src, lsn, tie, kind), (key, value) in records:
            if src != source:
                source, end, level = src, None, 0
            lsn, kind = -lsn, -kind
            at = (src[1] if src[0] else None, end[1] if end else None)
            if kind in (COMMIT, ABORT):
                end, level = (kind, lsn), 0
            elif kind == ROLLBACK:
                level += 1
                yield "r", *at, level, lsn, None, None, -tie
            elif kind == SAVEPOINT:
                level = max(0, level - 1)
            elif level:
                yield "u", *at, level, lsn, key, None, -tie
            elif end and end[0] == COMMIT:
                yield "c", *at, 0, lsn, key, value, -tie
            else:
                yield "a", *at, 0, lsn, key, None, -tie

    schema = "what string, source string, end long, level long, lsn long, key long, value long, tie long"
    return cut(log.sparkSession.createDataFrame(rows.mapPartitionsWithIndex(run), schema), "fates")


def _last_seen(rows: RDD, group, marks, out) -> RDD:
    """Run over sorted ``rows`` with the value of the last mark of the group in hand: ``out(record, value)`` for each record.

    ``group(record)`` names its group, ``marks(record)`` is (its value,) or None. A partition tells only its first and last groups and the last value.
    """

    def summary(i, records):
        first = last = value = None
        alone = True
        for r in records:
            g = group(r)
            if g != last:
                alone, first = last is None, g if first is None else first
                last, value = g, None
            value = marks(r) or value
        if last is not None:
            yield i, first, last, alone, value

    into, value, was = {}, None, None
    for i, first, last, alone, own in sorted(rows.mapPartitionsWithIndex(summary).collect(), key=lambda x: x[0]):  # a row a partition
        if first == was and value:
            into[i] = (first, value)
        value = own or (value if alone and first == was else None)
        was = last

    def run(i, records):
        was, value = into.get(i, (None, None))
        for r in records:
            if (g := group(r)) != was:
                was, value = g, None
            yield from out(r, value)
            value = marks(r) or value

    return rows.mapPartitionsWithIndex(run)


def undone_by_rollbacks(fate: DataFrame, parts: int) -> DataFrame:
    """(lsn, by, key) of changes that a rollback undoes."""
    own = fate.where("what IN ('u', 'r')")
    rows = own.rdd.map(lambda r: ((_source(r.source), (0, 0) if r.end is None else (1, r.end), r.level, -r.lsn, -(r.tie or 0), r.what == "u"), r.key))
    rows = secondary_sort(rows, own.count(), parts)
    found = _last_seen(rows, lambda r: r[0][:3], lambda r: None if r[0][5] else (-r[0][3],), lambda r, by: [(-r[0][3], by[0], r[1])] if r[0][5] else [])
    return fate.sparkSession.createDataFrame(found, "lsn long, by long, key long")


def commit_order(log: DataFrame, every: int) -> DataFrame:
    """(source, end, epoch) of each commit: by ascending doc_id, then source; every ``every`` commits make an epoch, counted from 1."""
    commits = log.where(F.col("kind") == COMMIT).select(F.col("source"), F.col("lsn").alias("end"), F.lit(1).alias("one"), F.monotonically_increasing_id().alias("where"))
    ranked = scan(commits, [], ["end", F.col("source").asc_nulls_first(), "where"], {"rank": ("sum", "one")}, "commits")
    return ranked.select("source", "end", F.expr(f"(rank - 1) div {every} + 1").alias("epoch"))


def epoch_deltas(fate: DataFrame, commits: DataFrame, parts: int) -> DataFrame:
    """(epoch, n, value): what the versions of each epoch add to the number of stored keys and to the sum of their values."""
    # a repeated commit record finds nothing left to commit
    first = commits.groupBy(F.col("source").alias("s"), F.col("end").alias("e")).agg(F.min("epoch").alias("epoch"))
    own = fate.where("what = 'c'").join(first.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("end") == F.col("e")))
    own = cut(own.select("key", "end", "source", "lsn", "tie", "value", "epoch"), "versions")
    rows = own.rdd.map(lambda r: ((r.key, r.end, _source(r.source), r.lsn, r.tie), (r.value, r.epoch)))
    rows = secondary_sort(rows, own.count(), parts)

    def delta(record, before):
        new, epoch = record[1]
        old = before[0] if before else None
        if new != old:
            yield epoch, (new is not None) - (old is not None), (new or 0) - (old or 0)

    found = _last_seen(rows, lambda r: r[0][0], lambda r: (r[1][0],), delta)
    found = fate.sparkSession.createDataFrame(found, "epoch long, n long, value long")
    none = F.lit(0).cast("long")
    return found.union(commits.select("epoch", none, none)).groupBy("epoch").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def replay(log: DataFrame, every: int = 4, parts: int | None = None) -> DataFrame:
    """States and undone changes of a log (lsn, source, kind, key, value, tie), as ``log_of`` makes it: kind, id, n, value.

    Each source (null is one) runs transactions, ended by a commit, an abort or the end of the log (an abort). A rollback undoes the
    changes since the latest savepoint of its transaction that are still in force, or since its start, and removes that savepoint. Commits, in the order of lsn
    (then source, null first), apply what is left of their transactions in log order. After each ``every`` commits, and after the last: ``state``, the
    epoch from 1, the number of stored keys, the sum of their values. For each undone change: ``abort`` or ``rollback``, its lsn, that of the record that
    undid it (null: the end), its key. Records of one lsn and source are ordered by tie; repeated records count each. An empty log gives no rows.
    """
    parts = parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log = cut(log, "log")
    fate = fates(log, parts)
    commits = commit_order(log, every)
    states = scan(epoch_deltas(fate, commits, parts), [], ["epoch"], {"keys": ("sum", "n"), "total": ("sum", "value")}, "states")
    aborted = fate.where("what = 'a'").select(F.lit("abort").alias("kind"), F.col("lsn").alias("id"), F.col("end").alias("n"), F.col("key").alias("value"))
    rolled = undone_by_rollbacks(fate, parts).select(F.lit("rollback").alias("kind"), F.col("lsn").alias("id"), F.col("by").alias("n"), F.col("key").alias("value"))
    out = states.select(F.lit("state").alias("kind"), F.col("epoch").alias("id"), F.col("keys").alias("n"), F.col("total").alias("value")).union(aborted).union(rolled)
    release(log)
    return out
