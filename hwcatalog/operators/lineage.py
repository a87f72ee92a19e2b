"""Version lineage: newest of a key, supersession, chains."""

from __future__ import annotations

import random
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import version_pieces
from ..sources.scratch import cut, release


def best_version(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The newest enabled entry of each key; of equals the first by pos."""
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"), "pos")
    return entries.where("enabled").withColumn("_v", version_pieces(F.col("version"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_v")


def supersede(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of both after the new ones came, with arch, category and ids as key: ``driver_id, enabled, supersedes, superseded_by, note``.

    A new entry newer than the best of its key before it disables that one and points to it; an older one stays beside it, and the
    same id is no change. New entries count in order of pos, so each may supersede the one before.
    """
    cols = ["driver_id", "key", "version", "pos"]
    keyed = lambda df: df.withColumn("key", F.concat_ws("|", F.coalesce("arch", F.lit("")), F.lower(F.coalesce("category", F.lit(""))), F.array_join(F.array_sort("hwids"), "|")))
    old = keyed(prior)
    fresh = keyed(new).join(old.select("driver_id"), "driver_id", "left_anti")
    best = best_version(old, ["key"]).select(*cols).withColumn("is_new", F.lit(0))
    line = best.union(fresh.select(*cols).withColumn("is_new", F.lit(1))).withColumn("v", version_pieces(F.col("version")))
    order = Window.partitionBy("key").orderBy("is_new", "pos")
    line = line.withColumn("top", F.max("v").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # heads of the chain: entries newer than all before them
    heads = line.where("top IS NULL OR v > top")
    heads = heads.withColumn("supersedes", F.lag("driver_id").over(order)).withColumn("superseded_by", F.lead("driver_id").over(order))
    link = heads.select("driver_id", F.col("supersedes").alias("s"), F.col("superseded_by").alias("b"))
    both = old.select("driver_id", "enabled", F.lit(0).alias("is_new")).union(fresh.select("driver_id", "enabled", F.lit(1)))
    out = both.join(link, "driver_id", "left")
    return out.select("driver_id", (F.col("enabled") & F.col("b").isNull()).alias("enabled"), F.when(F.col("is_new") == 1, F.col("s")).alias("supersedes"), F.col("b").alias("superseded_by"), F.when(F.col("b").isNotNull(), F.concat(F.lit("superseded by "), "b")).alias("note"))


def _numbered(links: DataFrame, number=F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """The ids of ``links`` (a, b) with a number each (n, id), and the links by number, the greater first.

    ``number`` hashes a seed and an id to 64 bits; should two ids get one number, all are numbered anew with the next seed.
    """
    for seed in count():
        of = lambda c: number(F.lit(seed), F.col(c))  # noqa: B023, E731
        ids = cut(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(of("id").alias("n"), "id"), "ids")
        if ids.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
            return ids, links.select(F.greatest(of("a"), of("b")).alias("a"), F.least(of("a"), of("b")).alias("b")).distinct()
        release(ids)


def version_chains(entries: DataFrame) -> DataFrame:
    """(driver_id, chain): entries joined by supersedes or superseded_by, either way; chain is the least id in it.

    Entries are numbered by hashes. In a round each is drawn to the least of itself and its neighbours, in an order that changes with the round, and links
    go on between what entries were drawn to; of a path about half is left, so all rounds together cost about as much as the first two. Then
    the rounds are followed back, and the ids come in. Rounds are written to the shared folder; entries without links take no part.
    """
    links = entries.select(F.col("driver_id").alias("a"), F.explode(F.array("supersedes", "superseded_by")).alias("b")).where("b IS NOT NULL AND a <> b")
    links = cut(links, "links")
    ids, e = _numbered(links)
    e = cut(e, "chains")
    release(links)
    rng, rounds = random.Random(1), []
    while not e.isEmpty():
        turn = F.lit(rng.getrandbits(64) - 2**63)
        turned = lambda c: F.col(c).bitwiseXOR(turn)  # noqa: B023, E731
        near = e.union(e.select("b", "a")).groupBy("a").agg(F.min(turned("b")).alias("m"))
        drawn = cut(near.select(F.col("a").alias("n"), F.least(turned("a"), "m").bitwiseXOR(turn).alias("to")), "round")
        rounds.append(drawn)
        ends = [drawn.select(F.col("n").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        after = e.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to").select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct()
        after = cut(after, "chains")
        release(e)
        e = after
    release(e)
    tied = ids.select("n", F.col("n").alias("b")) if not rounds else rounds[-1].select("n", F.col("to").alias("b"))
    for drawn in rounds[-2::-1]:  # what isn't drawn further was the last of its chain
        tied = drawn.join(tied.select(F.col("n").alias("to"), "b"), "to", "left").select("n", F.coalesce("b", "to").alias("b"))
    named = cut(ids.join(tied, "n").select(F.col("id").alias("driver_id"), "b"), "named")
    for done in (ids, *rounds):
        release(done)
    linked = named.join(named.groupBy("b").agg(F.min("driver_id").alias("chain")), "b").select("driver_id", "chain")
    rest = entries.select("driver_id").distinct().join(named, "driver_id", "left_anti")
    return linked.union(rest.select("driver_id", F.col("driver_id").alias("chain")))


def with_head(members: DataFrame) -> DataFrame:
    """Chain members in order of date, with is_current: the first that is enabled and not superseded, else the last."""
    w = Window.partitionBy("chain").orderBy("date_added", "driver_id")
    n = members.withColumn("n", F.row_number().over(w))
    head = F.coalesce(F.min(F.when(F.col("enabled") & F.col("superseded_by").isNull(), F.col("n"))).over(Window.partitionBy("chain")), F.max("n").over(Window.partitionBy("chain")))
    return n.withColumn("is_current", F.col("n") == head)
