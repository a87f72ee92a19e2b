"""Comparing a local inventory with the catalog, and duplicate audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ARCH_BONUS, JACCARD_THRESHOLD
from ..functions.text import normalize_class, normalize_provider
from ..functions.versions import compare, driver_date, version_chunks, version_digits, version_pieces
from ..sources.scratch import cut


def _set_key(c: str = "hwids"):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.upper(F.trim(x))))), "|")


def reconcile(local: DataFrame, repo: DataFrame) -> DataFrame:
    """For each local record (local_id, hwids, arch, category, provider, version) its catalog entry by the first step that finds one, and status.

    Steps: ids with arch and category; ids with arch; ids; overlap of ids of at least a quarter (times 1.2 for the same arch); provider
    with category and arch; provider with category. Status is NEW, OUTDATED (the local version is newer) or CURRENT. Within a step the best
    score, then the newest version, then the first entry goes. No step compares all with all: overlaps come from shared ids.
    """
    ids = F.array_distinct(F.transform("hwids", lambda x: F.upper(F.trim(x))))
    key = F.when(F.col("k") != "", F.col("k"))
    name = [F.when(key.isNotNull(), F.xxhash64(*seed, key)).alias(n) for n, seed in (("k1", ()), ("k2", (F.lit(7),)))]  # of a set with ids, else null
    prep = lambda d, *own: d.withColumn("k", _set_key()).select(*own, *name, F.lower(F.coalesce("category", F.lit(""))).alias("c"), normalize_provider(F.coalesce("provider", F.lit(""))).alias("p"), "arch", version_digits(F.col("version")).alias("v"), ids.alias("h"))
    l = cut(prep(local, "local_id"), "local")  # noqa: E741
    r = cut(prep(repo.where("enabled"), "driver_id", "pos"), "catalog")
    entry = F.struct("v", (-F.col("pos")).alias("first"), "driver_id")
    # the best of a wider key is the best of the best of the narrower ones
    best = lambda d, keys, e="e": d.groupBy(*keys).agg(F.max(e).alias("e"))
    some_ids = "k1 IS NOT NULL"
    s1 = cut(best(r.where(some_ids), ["k1", "k2", "arch", "c"], entry), "best")
    s2 = best(s1, ["k1", "k2", "arch"])
    s5 = cut(best(r.where("p <> '' AND c <> ''"), ["p", "c", "arch"], entry), "best")
    out = l.drop("h")
    for step, keys, found in ((1, ["k1", "k2", "arch", "c"], s1), (2, ["k1", "k2", "arch"], s2), (3, ["k1", "k2"], best(s1, ["k1", "k2"])), (5, ["p", "c", "arch"], s5), (6, ["p", "c"], best(s5, ["p", "c"]))):
        out = out.join(found.withColumnRenamed("e", f"e{step}"), keys, "left")
    out = cut(out, "steps")
    # overlaps only for what no set of ids settles, against one entry for each set and arch
    reps = cut(r.where(some_ids).groupBy("k1", "k2", "arch").agg(F.max(entry).alias("e"), F.first("h").alias("h")), "sets")
    left = cut(l.where("size(h) > 0").join(out.where("e1 IS NULL AND e2 IS NULL AND e3 IS NULL").select("local_id"), "local_id", "left_semi").select("local_id", "arch", "h"), "left")
    j = overlaps(left.select(F.col("local_id").alias("id"), F.col("h").alias("hwids")), reps.select(F.col("e.driver_id").alias("id"), F.col("h").alias("hwids")), JACCARD_THRESHOLD / ARCH_BONUS)
    j = j.join(left.select(F.col("local_id").alias("a_id"), F.col("arch").alias("la")), "a_id").join(reps.select(F.col("e.driver_id").alias("b_id"), "arch", "e"), "b_id")
    j = j.withColumn("score", F.col("exact") * F.when(F.col("la") == F.col("arch"), ARCH_BONUS).otherwise(1.0)).where(F.col("score") >= JACCARD_THRESHOLD)
    near = j.groupBy(F.col("a_id").alias("local_id")).agg(F.max(F.struct("score", "e")).alias("near"))
    out = out.join(near, "local_id", "left")
    step = F.coalesce(*(F.when(F.col(c).isNotNull(), n) for n, c in ((1, "e1"), (2, "e2"), (3, "e3"), (4, "near"), (5, "e5"), (6, "e6"))))
    hit = F.coalesce("e1", "e2", "e3", "near.e", "e5", "e6")
    score = F.when(step == 4, F.col("near.score")).when(step.isNotNull(), 0.0)
    status = F.when(step.isNull(), "NEW").when(compare(F.col("v"), hit["v"]) > 0, "OUTDATED").otherwise("CURRENT")
    return out.select("local_id", hit["driver_id"].alias("driver_id"), step.alias("step"), F.round(score, 6).alias("score"), status.alias("status"))


def overlaps(a: DataFrame, b: DataFrame, least: float, ordered: bool = False) -> DataFrame:
    """(a_id, b_id, jaccard, exact) of records (id, hwids: distinct) that share at least that part of their ids; with ``ordered`` a_id < b_id.

    Of two such sets the rarest ids of either, ``n - ceil(least * n) + 1`` of n in one order for all, have one in common, and the
    smaller has at least that part of the larger's size: only pairs that pass both are made, so an id that many records have,
    being last in the order, is hardly ever looked up. What is left of either set after the first common id, and a mask of 64 bits
    for all its ids, bound how many they can share: a pair that can't share enough goes no further. Ids are named by 64 bits up to
    here; the pairs left are compared as they are.
    """
    each = lambda d: d.select("id", F.explode("hwids").alias("x")).select("id", F.xxhash64("x").alias("h"))
    often = (each(a) if ordered else each(a).union(each(b))).groupBy("h").agg(F.count("*").alias("f"))

    def prefixes(d: DataFrame) -> DataFrame:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))
        by = each(d).join(often, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("x"), F.bit_or(bit).alias("m"))
        n = F.size("x")
        kept = F.slice("x", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
        return by.select("id", n.alias("n"), "m", F.posexplode(kept).alias("at", "e")).select("id", "n", "m", "at", F.col("e.h").alias("h"))

    named = lambda d, p: d.select("h", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "m", "at")))
    one = cut(prefixes(a), "prefixes")
    x, y = named(one, "a"), named(one if ordered else prefixes(b), "b")
    near = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * least - 1e-9
    alone = lambda p, q: F.col(f"{p}_n") - F.bit_count(F.col(f"{p}_m").bitwiseAND(F.bitwise_not(F.col(f"{q}_m"))))
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"), alone("a", "b"), alone("b", "a"))
    enough = most >= (F.col("a_n") + F.col("b_n")) * (least / (1 + least)) - 1e-9
    pairs = x.join(y, "h").where(near & enough & (F.col("a_id") < F.col("b_id") if ordered else F.lit(True))).select("a_id", "b_id").distinct()
    both = pairs.join(a.select(F.col("id").alias("a_id"), F.col("hwids").alias("x")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("hwids").alias("y")), "b_id")
    s = F.size(F.array_intersect("x", "y"))
    exact = s / (F.size("x") + F.size("y") - s)
    return both.select("a_id", "b_id", F.round(exact, 6).alias("jaccard"), exact.alias("exact")).where(F.col("exact") >= least - 1e-12)


def self_overlaps(records: DataFrame, least: float) -> DataFrame:
    """(a_id, b_id, jaccard) among records (id, hwids: distinct): pairs of classes of equal sets, each named by its least id, and each class with its other members."""
    sets = records.select("id", F.array_sort("hwids").alias("hwids"))
    keyed = cut(sets.select("*", F.xxhash64("hwids").alias("k1"), F.xxhash64(F.lit(7), "hwids").alias("k2")), "sets")  # a set's name
    classes = cut(keyed.groupBy("k1", "k2").agg(F.min(F.struct("id", "hwids")).alias("r"), F.count("*").alias("n")), "classes")
    some = classes.where("n > 1").select("k1", "k2", F.col("r.id").alias("rep"))
    members = keyed.select("id", "k1", "k2").join(some, ["k1", "k2"]).where("id <> rep").select(F.col("rep").alias("a_id"), F.col("id").alias("b_id"), F.lit(1.0).alias("jaccard"))
    reps = classes.select("r.*")
    return overlaps(reps, reps, least, ordered=True).drop("exact").union(members)


def duplicate_audit(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """(in_id, driver_id, status, action) of incoming records whose ids, arch and category the catalog has, against its newest such entry."""
    key = lambda d, p: d.where(F.size("hwids") > 0).select(*[F.col(c) for c in d.columns], _set_key().alias(f"{p}k"), F.lower("category").alias(f"{p}c"))
    i = key(incoming, "i").select("in_id", "ik", "ic", F.col("arch").alias("ia"), F.col("version").alias("iv"))
    c = key(catalog.where("enabled"), "c").select("driver_id", "pos", "ck", "cc", F.col("arch").alias("ca"), F.col("version").alias("cv"))
    both = i.join(c, (F.col("ik") == F.col("ck")) & (F.col("ic") == F.col("cc")) & F.col("ia").eqNullSafe(F.col("ca")))
    a, b = version_pieces(F.col("iv")), version_pieces(F.col("cv"))
    w = Window.partitionBy("in_id").orderBy(F.desc(F.col("iv") == F.col("cv")), F.desc(b), "pos")
    best = both.withColumn("n", F.row_number().over(w)).where("n = 1")
    status = F.when(F.col("iv") == F.col("cv"), "exact").when(a > b, "newer_incoming").otherwise("older_incoming")
    action = F.when(status == "exact", "skip").when(status == "newer_incoming", "replace").otherwise("keep_new")
    return best.select("in_id", "driver_id", status.alias("status"), action.alias("action"))


def _ids_and_class(d: DataFrame, key: str, *more: Column) -> DataFrame:
    """(key, ..., h, blank, cls) of records: a row for each id, in upper case, with the type of their class. What is made of a record is made before its ids are dealt out."""
    blank = F.coalesce("category", F.lit("")) == ""
    made = d.select(key, *more, blank.alias("blank"), normalize_class(F.col("category")).alias("cls"), "hwids")
    rest = [c for c in made.columns if c != "hwids"]
    return made.select(*rest, F.explode("hwids").alias("h")).select(*rest, F.upper("h").alias("h")).where("h IS NOT NULL")


def class_matches(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(local_id, driver_id) pairs that share an id and whose classes agree, or the remote has none. Disabled remotes count.

    Ids and classes are joined together, so a pair whose classes differ is never made. Neither side is broadcast: the size of a file tells little of the ids in it.
    """
    x, y = _ids_and_class(local, "local_id").drop("blank"), _ids_and_class(remote, "driver_id")
    same = x.join(y.where("NOT blank").drop("blank").hint("merge"), ["h", "cls"]).select("local_id", "driver_id")
    any_ = x.select("local_id", "h").join(y.where("blank").select("driver_id", "h").hint("merge"), "h").select("local_id", "driver_id")
    return same.union(any_).distinct()


def _newness(version: str, date: str) -> Column:
    """What decides ``local_newer`` as one value in order: the version without zeros at its end, then whether the date can't be read, then the date."""
    v = version_chunks(F.col(version))
    end = F.array_max(F.transform(v, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    d = driver_date(F.col(date))
    return F.named_struct(F.lit("v"), F.slice(v, F.lit(1), end), F.lit("unread"), d.isNull(), F.lit("d"), d)


def classify_uploads(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(local_id, status): missing without a class match, updated if newer than every match, else present.

    Of all entries that have an id and a class only the newest can keep a local driver from being newer than all (of equal versions one
    whose date can't be read, else the latest), so entries are reduced to one an id and class before local drivers meet them.
    """
    newest = _ids_and_class(remote, "driver_id", _newness("version", "driver_date").alias("n")).groupBy("h", "blank", F.when(~F.col("blank"), F.col("cls")).alias("cls")).agg(F.max("n").alias("n"))
    x = _ids_and_class(local, "local_id").drop("blank")
    same = x.join(newest.where("NOT blank").drop("blank").hint("merge"), ["h", "cls"]).select("local_id", "n")
    any_ = x.select("local_id", "h").join(newest.where("blank").select("h", "n").hint("merge"), "h").select("local_id", "n")
    top = same.union(any_).groupBy("local_id").agg(F.max("n").alias("n"))
    both = local.select("local_id", _newness("version", "driver_date").alias("l")).join(top, "local_id", "left")
    later = ~F.col("l.unread") & ~F.col("n.unread") & (F.col("l.d") > F.col("n.d"))
    newer = F.when(F.col("l.v") == F.col("n.v"), F.coalesce(later, F.lit(False))).otherwise(F.col("l.v") > F.col("n.v"))
    return both.select("local_id", F.when(F.col("n").isNull(), "missing").when(newer, "updated").otherwise("present").alias("status"))


def conflicts(records: DataFrame) -> DataFrame:
    """(hwid, files, versions, archs) of ids that several files claim with different versions or archs."""
    e = records.select("file", "version", "arch", F.explode("hwids").alias("hwid")).withColumn("h", F.xxhash64("hwid"))
    # most ids are one file's: these are told by least and greatest names of 128 bits, which combine, and only the rest is counted
    names = [F.xxhash64("file").alias("f1"), F.xxhash64(F.lit(7), "file").alias("f2")]
    ends = e.where("file IS NOT NULL").select("h", *names).groupBy("h").agg(*(f(c).alias(f"{n}{c}") for c in ("f1", "f2") for n, f in (("a", F.min), ("b", F.max))))
    several = ends.where("af1 <> bf1 OR af2 <> bf2").select("h")
    g = e.join(several, "h", "left_semi").groupBy("hwid").agg(F.count_distinct("file").alias("files"), F.count_distinct("version").alias("versions"), F.count_distinct("arch").alias("archs"))
    return g.where("files > 1 AND (versions > 1 OR archs > 1)")
