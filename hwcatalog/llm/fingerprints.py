"""Document fingerprints from closed syncmers, in DataFrame functions alone.

The alphabet is characters. Of the k-mers of a text those are anchors whose least inner s-mer, by hash, is the first or the
last: a test that looks at the k-mer alone, so an anchor stays wherever its characters go, and texts with a passage in
common have its anchors in common, at places that differ by one shift. Anchors of a text that is put together
from others are theirs, but for those over the seams.

A fingerprint keeps, for each of 64 ranges of anchor hashes, the least anchor and its place. Likeness matches two
fingerprints by position: a common anchor counts if it is about as far from the common anchor before or after it
in both texts; the count is taken of the ranges with an anchor in either text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: k-mers of K characters, inner s-mers of S: INNER of them in a k-mer.
K, S = 10, 6
INNER = K - S + 1
#: Hex digits of a fingerprint's entry: 6 bits of range and 16 of the least anchor in it, in 6 digits, and its place in 8.
DIGITS = 14
#: Two common anchors keep their distance if it differs by at most so many characters, or this share of it.
SLACK, SHARE = 16, 8
_PLACE = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _upto(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def inner_hashes(text: Column) -> Column:
    """Hashes of all runs of S characters; in UTF-32 a place is an offset."""

    def runs(u: Column) -> Column:
        last = F.octet_length(u) - 4 * S + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last, F.lit(4))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.xxhash64(F.substring(u, at, F.lit(4 * S))))

    return let(F.encode(text, "UTF-32"), runs)


def _at_anchors(text: Column, make) -> Column:
    """``make(first inner hash, last, place)`` for each closed syncmer of a text, in text order."""

    def found(g: Column) -> Column:
        first, last = lambda i: F.get(g, i), lambda i: F.get(g, i + (INNER - 1))

        def closed(i: Column) -> Column:
            below = lambda x: reduce(Column.__and__, (x <= F.get(g, i + j) for j in range(1, INNER - 1)))
            return F.when(first(i) <= last(i), below(first(i))).otherwise(below(last(i)))

        return F.transform(F.filter(_upto(F.size(g) - INNER), closed), lambda i: make(first(i), last(i), i))

    return let(inner_hashes(text), found)


def anchors(docs: DataFrame, text: str = "text", out: str = "anchors") -> DataFrame:
    """``docs`` with its anchors, array<struct<hash bigint, pos int>> in text order. Null texts have none."""
    return docs.withColumn(out, _at_anchors(F.coalesce(F.col(text), F.lit("")), lambda a, b, i: F.struct(F.xxhash64(a, b).alias("hash"), i.alias("pos"))))


def positional_matches(a: str, b: str) -> Column:
    """For two anchors columns the shift that most shared anchors agree on and their number: struct<matches, shift>; null without any.

    Anchors that repeat within a text are taken at their first place.
    """
    shifts = f"filter(transform({a}, x -> get(filter({b}, y -> y.hash = x.hash), 0).pos - x.pos), s -> s is not null)"
    return F.expr(f"array_max(transform(array_distinct({shifts}), d -> named_struct('matches', size(filter({shifts}, s -> s = d)), 'shift', d)))")


def _top(x: Column) -> Column:
    """The top 22 bits of a hash, above 32 bits for a place."""
    return F.shiftleft(F.shiftrightunsigned(x, 42), 32)


def entries(text: Column) -> Column:
    """The anchors of a text as numbers: 22 bits of the hash, 32 of the place."""
    return _at_anchors(text, lambda a, b, i: _top(F.xxhash64(a, b)).bitwiseOR(i.cast("long")))


def _sketch(found: Column, text: Column) -> Column:
    """Of the entries of a text the least of each range; a text without an anchor is its own single one, the empty text has none."""
    whole = F.when(text != "", F.array(_top(F.xxhash64(text)))).otherwise(F.array().cast("array<bigint>"))
    least = lambda e: F.filter(e, lambda x, i: (i == 0) | (F.shiftright(x, 48) != F.shiftright(F.get(e, i - 1), 48)))
    return let(let(found, lambda e: F.when(F.size(e) > 0, F.sort_array(e)).otherwise(whole)), least)


def sketch(text: Column) -> Column:
    """The fingerprint of a text column as an array of entries. Equal texts have equal ones; the empty text, and null, none."""
    return let(F.coalesce(text, F.lit("")), lambda t: _sketch(entries(t), t))


def written(entries_: Column) -> Column:
    """A fingerprint as a string of hex digits."""
    return F.array_join(F.transform(entries_, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def read(fingerprint: Column) -> Column:
    """The entries of a fingerprint that is written as a string."""
    return F.transform(_upto((F.length(fingerprint) / DIGITS).cast("int") - 1), lambda i: F.conv(F.substring(fingerprint, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for the entries of two fingerprints; 1 for two empty ones, 0 if one is empty."""
    keys = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    ranges = F.size(F.array_union(F.transform(a, lambda v: F.shiftright(v, 48)), F.transform(b, lambda v: F.shiftright(v, 48))))
    place = lambda x, of, key: F.get(x, (F.array_position(of, key) - 1).cast("int")).bitwiseAND(F.lit(_PLACE))

    def pairs(ka: Column, kb: Column) -> Column:
        both = F.transform(F.array_intersect(ka, kb), lambda key: F.struct(place(a, ka, key).alias("at"), place(b, kb, key).alias("to")))
        return F.sort_array(both)

    def held(s: Column) -> Column:
        def near(p: Column, q: Column) -> Column:
            there, here = p["to"] - q["to"], p["at"] - q["at"]
            return F.abs(there - here) <= F.greatest(F.lit(SLACK), F.floor(F.abs(here) / SHARE))

        return F.when(F.size(s) == 1, 1).otherwise(F.size(F.filter(s, lambda p, i: near(p, F.get(s, i - 1)) | near(p, F.get(s, i + 1)))))

    common = let(keys(a), lambda ka: let(keys(b), lambda kb: pairs(ka, kb)))
    return F.when(a == b, 1.0).otherwise(let(common, held) / ranges)


def _ranged(docs: DataFrame, per_range: int, most_ranges: int) -> DataFrame:
    """``docs`` (doc_id, text) with did (null last in descending order), h, the text's hash, and range, which numbers ranges of (did, h).

    Ranges are as many as the table's rows call for; one id that would fill several is dealt to as many by h.
    """
    did = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    keyed = docs.withColumn("did", did).withColumn("h", F.xxhash64("text"))
    n = docs.count()
    ranges = max(1, min(most_ranges, math.ceil(n / per_range)))
    cuts = docs.select(did.alias("d")).agg(F.percentile_approx("d", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(10 * ranges)) if ranges > 1 else F.array()).first()[0]
    bounds = sorted(cuts or [])
    # two steps: which run of bounds, then where in the run
    step = math.isqrt(len(bounds)) + 1
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda x: F.expr(f"cast(array({', '.join(f'{v}L' if v > -(2**63) else '-9223372036854775807L - 1L' for v in x)}) as array<bigint>)")
    below = lambda x: F.size(F.filter(x, lambda v: v < F.col("did")))
    if not bounds:
        return keyed.withColumn("range", F.lit(0).cast("long"))
    run = below(longs([r[-1] for r in runs]))
    inner = F.coalesce(F.get(F.array(*map(longs, runs)), F.col("run")), F.array().cast("array<bigint>"))
    keyed = keyed.withColumn("run", run).withColumn("range", (F.col("run") * step + below(inner)).cast("long"))
    often = {v: bounds.count(v) for v in dict.fromkeys(bounds) if bounds.count(v) > 1} if len(set(bounds)) < len(bounds) else {}
    if often:  # h in equal shares, upwards
        times = F.element_at(F.create_map(*(F.lit(x) for p in often.items() for x in p)), F.col("did"))
        share = F.floor((F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 32) * times) / F.lit(2.0**32)).cast("long")
        keyed = keyed.withColumn("range", F.col("range") + F.coalesce(share, F.lit(0)))
    return keyed.drop("run")


def _with_next(rows: DataFrame, tops: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` (did, h, range, ...) with ``column`` of the next row, by descending (did, h); after the last comes the first.

    Each range also gets the first row of the range after it as a guest, so no task sees all rows. ``tops`` names these: a row a range.
    """
    marked = rows.join(F.broadcast(tops), ["range", "did", "h"], "left")
    guest = F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    names = [c for c in rows.columns if c != "range"]
    dealt = marked.select(*names, F.inline(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    w = Window.partitionBy("range").orderBy("guest", F.desc("did"), F.desc("h"))
    return dealt.select(*names, "range", "guest", F.lead(column).over(w).alias(out)).where("NOT guest").drop("guest")


def compare_with_edits(docs: DataFrame, per_range: int = 2000, most_ranges: int = 65536) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has the last third of its characters replaced by the first as many (or all) of the next document. Null
    texts are empty. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A table of
    one row is its own next; an empty table gives an empty result. Rows of one doc_id follow each other by their text's hash,
    null ids come last. Texts move once, to ranges of about ``per_range`` rows; the driver holds a number a range.
    """
    rows = _ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), per_range, most_ranges)
    tops = rows.groupBy("range").agg(F.max(F.struct("did", "h")).alias("t"))
    order = Window.orderBy("range")  # one row a range
    # in descending order a range comes before the one below it, and the lowest before the highest
    before = F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy()))
    tops = cut(tops.select("range", F.col("t.did").alias("did"), F.col("t.h").alias("h"), before.alias("before")), "tops")
    both = _with_next(rows, tops, "text", "next_text")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = both.select("doc_id", "did", "h", "range", "text", n.alias("n"), (n - third).alias("kept"), F.substring("next_text", F.lit(1), third).alias("tail"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("kept")), F.col("tail")))
    start = F.greatest(F.lit(0), F.col("kept") - (K - 1))
    seam = F.substring("edited", start + 1, F.col("kept") + (K - 1) - start)
    moved = lambda e, by: F.transform(e, lambda x: x + by.cast("long"))

    def two(mine: Column) -> Column:
        before = F.filter(mine, lambda x: x.bitwiseAND(F.lit(_PLACE)) <= F.col("kept") - K)
        theirs = F.concat(before, moved(entries(seam), start), moved(entries(F.col("tail")), F.col("kept")))
        return F.struct(_sketch(mine, F.col("text")).alias("fp"), _sketch(theirs, F.col("edited")).alias("efp"))

    done = both.select("doc_id", "did", "h", "range", "n", F.sha2("edited", 256).alias("sha"), let(entries(F.col("text")), two).alias("f"))
    done = cut(done.select("doc_id", "did", "h", "range", "n", "sha", "f.fp", "f.efp"), "fingerprints")
    out = _with_next(done, tops, "fp", "next_fp")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), written(F.col("fp")).alias("fingerprint"), written(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
