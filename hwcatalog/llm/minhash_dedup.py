"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Each text gets two small collections of ``groups`` hashes, each hash made of ``rows`` minima. A table
key is a pair, one hash of either collection, so ``2 * groups * rows`` minima give ``groups**2`` tables:
about the square root of what independent tables would need. A pair of similarity s meets in some
table with probability ``(1 - (1 - s**rows) ** groups) ** 2`` (0.9994 at 0.8 with 8 groups of 2).

Buckets are never expanded into all pairs. Members are compared with pivots first (linear in the
bucket); buckets whose members are then in one component are done. In the others, whoever is outside
the bucket's largest component is compared with those around it by an exact prefix join: of two sets
of that similarity the rarest shingles, a fifth of a set and one more, have one in common. Lists of a
shingle are looked through in blocks of bounded size, so no group meets in one task. So of the pairs that
meet in a table, all that reach the similarity end in one component.

A set is named by 128 bits of a digest; its first 64 only find candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, DOCS, blocked_pairs, connected_components, cut, fresh, long_word_hashes, mix, release, text_slices, word_hashes

_SEEDS = np.random.default_rng(77).integers(1, 2**63, (2, 256), dtype=np.uint64)
_SEEDS[1] = _SEEDS[1] * _U(2) + _U(1)
_MULT = np.random.default_rng(78).integers(1, 2**62, 64, dtype=np.uint64) * _U(2) + _U(1)
_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(column, width: int):
    """For each text of an Arrow column, the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    A text with fewer words has one shingle, its whole sequence; a text without words (or null) has none.
    """
    for _, data, ends in text_slices(column):
        if len(ends) == 1:
            h = long_word_hashes(data)
            last = np.array([len(h)])
        else:
            h, last = word_hashes(data, ends)
        n = len(h) - width + 1
        with np.errstate(over="ignore"):
            s = mix(sum((h[i : i + n] * _MULT[i] for i in range(width)), np.zeros(n, np.uint64))) if n > 0 else _EMPTY
            a = 0
            for b in last:
                if b - a >= width:
                    yield np.unique(s[a : b - width + 1])
                elif b > a:
                    yield mix(np.array([sum((int(h[a + i]) * int(_MULT[32 + i]) for i in range(b - a)), int(b - a)) & (2**64 - 1)], np.uint64))
                else:
                    yield _EMPTY
                a = b


def set_name(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a 128-bit name of a shingle set."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def signatures(docs: DataFrame, width: int, groups: int, rows: int) -> DataFrame:
    """(doc_id, set_id, alt, n_shingles, a, b) per row of ``docs`` (doc_id, text); a, b: the two hash collections."""
    x, m = _SEEDS[0, : 2 * groups * rows, None], _SEEDS[1, : 2 * groups * rows, None]

    def run(batches):
        for batch in batches:
            ids, alts, sizes, hashes = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column(1), width):
                    one, two = set_name(s)
                    ids.append(one)
                    alts.append(two)
                    sizes.append(len(s))
                    if len(s):
                        low = np.full(len(x), np.iinfo(np.uint64).max, np.uint64)
                        for i in range(0, len(s), 4096):  # bounded memory for very long texts
                            low = np.minimum(low, ((s[None, i : i + 4096] ^ x) * m).min(axis=1))
                        hashes.append(mix((low.reshape(-1, rows) * _MULT[:rows]).sum(axis=1, dtype=np.uint64)).view(np.int64))
                    else:
                        hashes.append(np.zeros(2 * groups, np.int64))
            flat = np.array(hashes, np.int64).reshape(-1, 2, groups)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(flat[:, k].reshape(-1)), groups).cast(pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(alts, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "set_id", "alt", "n_shingles", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, set_id long, alt long, n_shingles long, a array<long>, b array<long>")


#: Longs of the parities of a set: 1024 bits.
WORDS = 16


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS bits whether an odd number of shingles falls on it: two sets differ in no more bits than shingles."""
    out = np.zeros(WORDS, np.uint64)
    np.bitwise_xor.at(out, (s & _U(WORDS - 1)).astype(np.int64), _U(1) << ((s >> _U(8)) & _U(63)))
    return out


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(set_id, alt, s, bits) for each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            ids, alts, parts = [], [], []

            def out():
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(np.concatenate([*parts, _EMPTY]).view(np.int64)))
                bits = pa.ListArray.from_arrays((np.arange(len(parts) + 1) * WORDS).astype(np.int32), pa.array(np.concatenate([parities(p) for p in parts]).view(np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(alts, pa.int64()), lists, bits], names=["set_id", "alt", "s", "bits"])

            held = 0
            for s in shingle_sets(batch.column(1), width):
                one, two = set_name(s)
                ids.append(one)
                alts.append(two)
                parts.append(s)
                held += len(s)
                if held > 2_000_000:
                    yield out()
                    ids, alts, parts, held = [], [], [], 0
            if ids:
                yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "set_id long, alt long, s array<long>, bits array<long>")


def _name():
    return F.struct("set_id", "alt")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) of set ids, the names (u, v) of those whose sets reach the similarity."""
    left = pairs.join(sets.select(F.col("set_id").alias("u"), _name().alias("nu"), F.col("s").alias("su")), "u")
    both = left.join(sets.select(F.col("set_id").alias("v"), _name().alias("nv"), F.col("s").alias("sv")), "v")
    n = F.size(F.array_intersect("su", "sv"))
    both = both.select(F.col("nu").alias("u"), F.col("nv").alias("v"), n.alias("i"), (F.size("su") + F.size("sv")).alias("t"))
    return both.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("u", "v")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (u, v) of set ids in different components among ``members`` (main, set_id, comp) of one main, that may reach the similarity.

    The rarest ``n - ceil(percent * n / 100) + 1`` shingles of either set, in the same order, must have one in common, the sizes must
    allow the similarity, and so must the parities: sets that reach it differ in at most ``(100 - percent) / (100 + percent)`` of
    their sizes' sum. Only pairs that pass all become rows.
    """
    rows = members.join(sets.select("set_id", "s"), "set_id")
    each = rows.select("main", "set_id", F.explode("s").alias("g"))
    df = each.groupBy("main", "g").agg(F.count("*").alias("df"))
    ranked = each.join(df, ["main", "g"]).groupBy("main", "set_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("df", "g"))).alias("by"))
    first = ranked.select("main", "set_id", "n", F.explode(F.slice("by", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))).alias("e")).where("e.df > 1")
    words = [F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(WORDS)]
    first = first.join(members, ["main", "set_id"]).join(sets.select("set_id", *words), "set_id")
    first = first.select(F.struct("main", "e.g").alias("key"), F.col("set_id").alias("id"), "n", "comp", (F.col("comp") != F.col("main")).alias("out"), *(f"b{i}" for i in range(WORDS)))
    first = cut(first, "prefixes")
    differ = " + ".join(f"bit_count(x_b{i} ^ y_b{i})" for i in range(WORDS))
    near = f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) AND {100 + percent} * ({differ}) <= {100 - percent} * (x_n + y_n)"
    return blocked_pairs(first, "out", f"x_comp != y_comp AND {near}", block)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, groups: int = 8, rows: int = 2, orders: int = 6, block: int = 512) -> DataFrame:
    """Components of documents linked by shingle sets with ``100 * intersection >= percent * union``.

    ``docs`` needs doc_id and text; other columns are ignored. Returns one row per row of ``docs``:
    doc_id, n_shingles (long), component_id (the least doc_id reachable) and kept (doc_id = component_id).
    Texts that are null, empty or without words have no shingles and are linked with nothing. Repeated
    rows and exact copies share a component. Rows without doc_id are linked with nothing either: their
    component_id is null and they are kept. ``orders`` is how many pivots a bucket's members may meet
    over all tables, ``block`` the most rows of either side in a block comparison.
    """
    size = docs.count()
    sig = cut(signatures(docs, width, groups, rows), "signatures", rows=size, per_file=DOCS)
    classes = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_id", "alt").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = cut(classes, "classes", rows=size)
    # tensored keys: every pair of one hash of a with one of b; the places are part of the key
    i, j = F.sequence(F.lit(0), F.lit(groups - 1)), F.sequence(F.lit(0), F.lit(groups - 1))
    pair = F.transform(i, lambda x: F.transform(j, lambda y: F.xxhash64(F.get("a", x), F.get("b", y), x * groups + y)))
    keys = classes.select("set_id", F.explode(F.flatten(pair)).alias("key"))
    turn = F.xxhash64("set_id", F.pmod("key", F.lit(orders)))
    pivots = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(turn.alias("o"), "set_id"))["set_id"].alias("pivot")).where("size > 1")
    buckets = cut(keys.join(pivots, "key"), "buckets", rows=size * groups * groups)
    n = buckets.count()
    # refused before sets move: sizes too far apart
    small = classes.select("set_id", "n").groupBy("set_id").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    side = lambda x: small.select(F.col("set_id").alias(x), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
    pairs = buckets.where("set_id != pivot").select(F.least("set_id", "pivot").alias("u"), F.greatest("set_id", "pivot").alias("v")).distinct()
    pairs = pairs.join(side("u"), "u").join(side("v"), "v").where(f"100 * u_high >= {percent} * v_low AND 100 * v_high >= {percent} * u_low")
    pairs = cut(pairs.select("u", "v"), "pairs", rows=n)
    few = pairs.count()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sets of all that share a bucket, each from its first document; these ids grow with the table, so they are hashed by partition
    need = cut(buckets.select("set_id").distinct(), "need", rows=n)
    want = classes.join(need, "set_id", "left_semi").select(F.col("first_doc").alias("doc_id")).distinct()
    text = plain.join(want.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = cut(sets_of(text, width).join(need, "set_id", "left_semi").dropDuplicates(["set_id", "alt"]), "sets", rows=need.count(), per_file=DOCS)
    links = cut(_confirmed(pairs, sets, percent), "links", rows=few, per_file=5000)
    comps = connected_components(links)
    # buckets with members in several components: all that is not yet compared there
    named = classes.select("set_id", "alt", _name().alias("node")).join(comps, "node", "left").select("set_id", F.xxhash64(F.coalesce("comp", "node")).alias("comp"))
    placed = buckets.select("key", "set_id").join(named, "set_id")
    per = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    state = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1 AND size > 2").select("key", F.col("top.comp").alias("main"))
    # the buckets that lie around one component are compared together, so a pair that met in many tables is compared once
    members = cut(placed.join(state, "key").select("main", "set_id", "comp").distinct(), "open", rows=n)
    more = cut(_confirmed(_prefix_pairs(members, sets, percent, block), sets, percent), "links")
    if not more.isEmpty():
        comps = connected_components(links.union(more))
    of = classes.select("first_doc", _name().alias("node")).join(comps, "node")
    heads = of.groupBy("comp").agg(F.min("first_doc").alias("head"))
    heads = of.join(heads, "comp").select("node", "head")
    firsts = classes.select("set_id", "alt", "first_doc", _name().alias("node")).join(heads, "node", "left").select("set_id", "alt", F.coalesce("head", "first_doc").alias("head"))
    for x in (buckets, pairs, need, sets, members):
        release(x)
    out = sig.select("doc_id", "set_id", "alt", "n_shingles").join(firsts, ["set_id", "alt"], "left")
    comp = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("head")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without the near duplicates: of each component the document with the least doc_id stays.

    All columns stay as they are. Rows that repeat a doc_id stay or go together.
    """
    (gone,) = fresh(docs, "gone")
    out = near_duplicates(docs.select("doc_id", "text"), **params).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
