"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

A line of at least ``min_chars`` characters is split into ``max_edits + 1`` segments. Of two lines within that
many edits one has a segment that the other holds unchanged at a place near its own, so segments
index a line and the substrings of another line at the places that length and segment allow probe
the index. Candidates are verified by a banded bit-parallel edit distance. Shorter lines match when equal.

Exact copies of a line are one distinct line throughout. Lines of a bucket of the index meet its least
line, the pivot. Where they are then still in several components, a large bucket is split by the same index
over what its lines hold besides the segment that they share, and small ones are looked through in blocks
of bounded size: of two lines within k edits the parities of hashed bigrams differ in 4 k bits at most.

A line is named by 128 bits of hashes; 64-bit numbers only find candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCS, blocked_pairs, connected_components, cut, fresh, release

TRIMMED = " \t\x0b\x0c\r"
#: Lines of either side of a block that is looked through.
BLOCK = 512
#: A bucket of more lines is split before it is looked through.
SPLIT = 8192
#: Pairs that are verified in a task.
VERIFIED = 5000
#: How often a bucket may be split by what its lines hold besides what they share.
LEVELS = 3
_LAST = 2**63 - 1  # stands for a null doc_id: after all others


def banded_distance(a: str, b: str, k: int) -> str:
    """SQL for the edit distance of two strings, given as SQL if it is at most k (up to 31), else some number above k.

    Bit-parallel dynamic programming on a band of 2k + 1 diagonals: bit i of a column's words stands for the
    row i - k below the diagonal; ``p`` and ``m`` hold where a cell is one more or one less than the cell above it.
    Strings of fewer than k characters aren't meant for it.
    """
    w, top = 2 * k + 1, 2 * k
    mask = f"{(1 << w) - 1}L"
    eq = " + ".join(f"if(coalesce(get(va, j - {k} + {i} - 1) = get(vb, j - 1), false), {1 << i}L, 0L)" for i in range(w))
    d0 = f"((((e & s.p) + s.p) ^ s.p) | e | s.m) & {mask}"
    row = "cast(size(va) - j as int)"
    step = f"""transform(transform(transform(array({eq}), e -> {d0}),
        d -> named_struct('d', d, 'hp', (s.m | ~(d | s.p)) & {mask}, 'hn', d & s.p)),
        x -> named_struct('p', (x.hn | ~(shiftright(x.d, 1) | x.hp)) & {mask}, 'm', shiftright(x.d, 1) & x.hp,
            'n', s.n + if(j <= size(va) - {k}, 1 - cast(shiftright(x.d, {top}) & 1L as int),
                cast(shiftright(x.hp, {row} + {k}) & 1L as int) - cast(shiftright(x.hn, {row} + {k}) & 1L as int))))[0]"""
    start = f"named_struct('p', {((1 << w) - 1) & ~((1 << k) - 1)}L, 'm', 0L, 'n', {k})"
    run = f"aggregate(if(size(vb) = 0, array(), sequence(1, size(vb))), {start}, (s, j) -> {step}, s -> s.n)"
    bound = f"transform(array(named_struct('a', split({a}, ''), 'b', split({b}, ''))), v -> {run.replace('va', 'v.a').replace('vb', 'v.b')})[0]"
    return f"if(abs(length({a}) - length({b})) > {k}, {k + 1}, {bound})"


def near(a: str, b: str, k: int) -> str:
    """SQL for whether two strings are within k edits.

    k edits touch k of the segments of a at most, and the others are in b within k places of their own. That is asked of
    2k + 2 segments, then of 12k, before the distance is computed of what lies between equal beginnings and ends.
    """

    def untouched(n: int) -> str:
        at = [f"cast(floor(length({a}) * {i} / {n}) as int)" for i in range(n + 1)]
        hits = " + ".join(f"if(locate(substring({a}, {at[i]} + 1, {at[i + 1]} - {at[i]}), substring({b}, greatest(1, {at[i]} + 1 - {k}), {at[i + 1]} - {at[i]} + {2 * k})) > 0, 1, 0)" for i in range(n))
        return f"({hits}) >= {n - k}"

    short = f"least(length({a}), length({b}))"
    same = lambda side: "greatest(0, " + ", ".join(f"if({side}({a}, {short} * {i} div 12) = {side}({b}, {short} * {i} div 12), {short} * {i} div 12, 0)" for i in range(1, 13)) + ")"
    ends = f"transform(array(named_struct('p', {same('left')}, 'q', {same('right')}, 'n', {short})), x -> named_struct('p', x.p, 'q', greatest(0, least(x.q, x.n - x.p))))"
    # k characters on either side stay, so that none of the two is too short for the band
    ends = f"transform({ends}, x -> named_struct('p', cast(greatest(0, x.p - {k}) as int), 'q', cast(greatest(0, x.q - {k}) as int)))"
    between = lambda t: f"substring({t}, x.p + 1, length({t}) - x.p - x.q)"
    inner = f"transform({ends}, x -> named_struct('a', {between(a)}, 'b', {between(b)}))"
    return f"{untouched(2 * k + 2)} AND {untouched(12 * k)} AND transform({inner}, x -> {banded_distance('x.a', 'x.b', k)})[0] <= {k}"


def places(k: int) -> list[tuple[int, int, int]]:
    """(g, i, shift) of a line's segments, and then of the other substrings by which it probes.

    For an indexed line of length l - g (g up to k) segment i starts at p; the probe's substring starts between
    max(p - i, p + g - (k - i)) and min(p + i, p + g + (k - i)), counting segments from 0.
    """
    found = [(g, i, s) for g in range(k + 1) for i in range(k + 1) for s in range(max(-i, g - (k - i)), min(i, g + k - i) + 1)]
    return sorted(found, key=lambda x: (x[0] != 0 or x[2] != 0, x))


def _bounds(n: str, k: int) -> tuple[str, str]:
    """SQL for where segment i of a line of length n - g begins and ends, from 0."""
    return f"cast(({n} - g) * i div {k + 1} as int)", f"cast(({n} - g) * (i + 1) div {k + 1} as int)"


def segment_keys(parts: DataFrame, k: int, own: bool = False) -> DataFrame:
    """(bucket, lid, at, key) for each of the ``places`` of each row of ``parts`` (bucket, lid, part); only the segments if ``own``.

    Characters are cut out of the line's UTF-32 form, where a place is an offset.
    """
    table = ", ".join(f"named_struct('at', {at}, 'g', {g}, 'i', {i}, 's', {s})" for at, (g, i, s) in enumerate(places(k)) if at <= k or not own)
    wide = parts.select("bucket", "lid", F.encode("part", "UTF-32").alias("u")).select("bucket", "lid", "u", F.expr("cast(octet_length(u) div 4 as int) as n"))
    low, high = _bounds("n", k)
    key = F.expr(f"xxhash64(substring(u, 4 * ({low} + s) + 1, 4 * ({high} - {low})), bucket, i, n - g)")
    return wide.select("bucket", "lid", "u", "n", F.inline(F.expr(f"array({table})"))).select("bucket", "lid", "at", key.alias("key"))


def without_shared(k: int) -> Column:
    """A part without the segment or substring at place ``at``; a NUL stands in its place."""
    table = ", ".join(f"named_struct('g', {g}, 'i', {i}, 's', {s})" for g, i, s in places(k))
    low, high = _bounds("length(part)", k)
    cut_ = "concat(substring(part, 1, {low} + x.s), '\\0', substring(part, {high} + x.s + 1))".format(low=low.replace("- g", "- x.g").replace("* i", "* x.i"), high=high.replace("- g", "- x.g").replace("(i +", "(x.i +"))
    return F.expr(f"transform(array(get(array({table}), at)), x -> {cut_})[0]")


def parities(line: str, k: int) -> Column:
    """64 bits of a line, each the parity of how many of its hashed bigrams fall on it; an edit changes four at most."""
    bits = f"transform(sequence(0, size(c)), i -> shiftleft(1L, cast(pmod(xxhash64(get(c, i - 1), get(c, i)), 64) as int)))"
    return F.expr(f"transform(array(split({line}, '')), c -> aggregate({bits}, 0L, (a, b) -> a ^ b))[0]")


def lines_of(docs: DataFrame) -> DataFrame:
    """(did, h, pos, line, name) of the lines that aren't blank: did and h name the row of ``docs``, line is trimmed."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.col("line")
    odd = reduce(Column.__or__, [t for c in TRIMMED for t in (line.startswith(c), line.endswith(c))])
    rows = rows.select("did", "h", "pos", F.when(odd, F.btrim("line", F.lit(TRIMMED))).otherwise(line).alias("line")).where("line != ''")
    # two 64-bit hashes, started differently
    return rows.withColumn("name", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(name, lid, line, n, first) of each distinct line: how often it occurs and its least did. Copies are gathered by partial sums."""
    by = lines.groupBy("name").agg(F.first("line").alias("line"), F.count("*").alias("n"), F.min("did").alias("first"))
    return by.select("name", F.col("name.a").alias("lid"), "line", "n", "first")


def _verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Of pairs (u, v) of lids, the names (u, v) of lines within k edits; the parities are asked first."""
    left = pairs.join(texts.select(F.col("lid").alias("v"), F.col("name").alias("nv"), F.col("line").alias("lv"), F.col("bits").alias("bv")), "v")
    both = left.join(texts.select(F.col("lid").alias("u"), F.col("name").alias("nu"), F.col("line").alias("lu"), F.col("bits").alias("bu")), "u")
    return both.where(f"bit_count(bu ^ bv) <= {4 * k}").where(near("lu", "lv", k)).select(F.col("nu").alias("u"), F.col("nv").alias("v"))


def line_links(distinct: DataFrame, max_edits: int, min_chars: int, block: int = BLOCK, split: int = SPLIT, levels: int = LEVELS) -> DataFrame:
    """(u, v): names of distinct lines of at least ``min_chars`` within ``max_edits`` edits; enough of them to join what belongs together."""
    k, held = max_edits, []

    def keep(df: DataFrame, what: str, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
        held.append(cut(df, what, rows, per_file))
        return held[-1]

    long_ = distinct.where(F.length("line") >= min_chars)
    size = distinct.count()
    parts = long_.select(F.lit(0).cast("long").alias("bucket"), "lid", F.col("line").alias("part"))
    texts = links = rest = None
    for level in range(levels + 1):
        # one row a key: its least indexed line is the pivot, whom all the others of the bucket meet
        index = segment_keys(parts, k, own=True).groupBy("key").agg(F.min("lid").alias("pivot"))
        buckets = keep(segment_keys(parts, k).join(index, "key").where("lid != pivot"), "buckets", size, 20_000)
        n = buckets.count()
        if texts is None:
            names = keep(buckets.select("lid").union(buckets.select("pivot")).distinct(), "names", 2 * n)
            # the names grow with the table: hashed by partition at any size, not broadcast
            texts = keep(long_.join(names.hint("shuffle_hash"), "lid", "left_semi").select("lid", "name", "line", parities("line", k).alias("bits")), "texts")
            few = texts.count()
            release(names)
        pairs = keep(buckets.select(F.least("lid", "pivot").alias("u"), F.greatest("lid", "pivot").alias("v")).distinct(), "pairs", n)
        found, before = _verified(pairs, texts, k), links
        links = keep(found, "links", n, VERIFIED) if links is None else keep(links.union(found), "links", links.count() + n, VERIFIED)
        for t in (pairs, before):
            release(t)
        comps = connected_components(links)
        placed = texts.select("lid", "name").join(comps.withColumnRenamed("node", "name"), "name", "left").select("lid", F.coalesce("comp", "name").alias("comp")).dropDuplicates(["lid"])
        placed = keep(placed, "placed", few)
        release(comps)
        of = buckets.join(placed, "lid").join(placed.select(F.col("lid").alias("pivot"), F.col("comp").alias("head")), "pivot")
        state = of.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("at") <= k).alias("indexed"), F.count_if(F.col("comp") != F.col("head")).alias("out"))
        state = state.where("out > 0 AND size > 1 AND indexed > 0").select("key", "size")
        # the pivot has met all; of the others some still may be near each other
        open_ = keep(of.join(state, "key").select("bucket", "key", "lid", "at", "size", "comp").dropDuplicates(["key", "lid", "at"]), "open", n)
        release(buckets)
        small = open_ if level == levels else open_.where(F.col("size") <= split)
        small = small.select("key", "lid", (F.col("at") <= k).alias("indexed")).distinct()
        rest = small if rest is None else rest.union(small)
        large = open_.where(F.col("size") > split)
        if level == levels or large.isEmpty():
            break
        parts = keep(large.join(parts, ["bucket", "lid"]).select(F.col("key").alias("bucket"), "lid", without_shared(k).alias("part")).distinct(), "parts", n)
    # of a pair one line is indexed, and the parities are near
    rest = keep(rest.join(placed, "lid").join(texts.select("lid", "bits"), "lid").withColumnRenamed("lid", "id"), "rest", rest.count())
    more = _verified(blocked_pairs(rest, "indexed", f"x_comp != y_comp AND bit_count(x_bits ^ y_bits) <= {4 * k}", block), texts, k)
    out = cut(links.union(more), "links", rows=links.count() + rest.count(), per_file=VERIFIED)
    for t in held:
        release(t)
    return out


def duplicate_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 20, hot: int = 1000) -> DataFrame:
    """(did, h, dropped): for each row of ``docs`` with lines to drop, their positions.

    Lines in one component of equal or near-equal lines are one class; its first line, by doc_id (null last), then the
    text's hash, then the place in the text, stays and all others go. Lines of fewer than ``min_chars`` characters, trimmed,
    match when equal; blank ones are left alone. Rows that repeat both doc_id and text are one document stored twice and keep
    the same lines. A line with more than one of ``hot`` occurrences of all lines is looked up by broadcast: there are fewer than ``hot``.
    """
    lines = lines_of(docs)
    occ = cut(lines.select("did", "h", "pos", "name"), "occurrences", rows=docs.count(), per_file=DOCS)
    total = occ.count()
    distinct = cut(distinct_lines(lines), "distinct", rows=total, per_file=50_000)
    links = line_links(distinct, max_edits, min_chars)
    found = connected_components(links)
    plain, comps = distinct.select("name", "n", "first"), found.withColumnRenamed("node", "name")
    known = plain.where("n > 1").join(comps, "name", "left").select("name", "n", "first", F.coalesce("comp", "name").alias("comp"))
    placed = cut(known.union(plain.where("n = 1").join(comps, "name")), "classes", rows=total)
    for t in (distinct, links, found):  # what nothing reads any more goes, not only at the end
        release(t)
    heads = placed.groupBy("comp").agg(F.min("first").alias("head"))
    known = cut(placed.join(heads, "comp").select("name", "n", "comp", "head"), "classes", rows=placed.count())
    release(placed)
    often = F.col("n") * hot > total
    heavy = F.broadcast(known.where(often).drop("n"))
    members = occ.join(heavy, "name").union(occ.join(heavy.select("name"), "name", "left_anti").join(known.where(~often).drop("n"), "name"))
    members = cut(members.select("did", "h", "pos", "comp", "head"), "members", rows=total)
    for t in (occ, known):
        release(t)
    at_head = members.where("did = head")
    firsts = at_head.groupBy("comp").agg(F.min(F.struct("h", "pos")).alias("keep"))
    gone = members.where("did != head").select("did", "h", "pos").union(at_head.join(firsts, "comp").where(F.struct("h", "pos") != F.col("keep")).select("did", "h", "pos"))
    return gone.groupBy("did", "h").agg(F.array_distinct(F.collect_list("pos")).alias("dropped"))


def drop_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated lines taken out of text, and n_lines and n_dropped (long) added.

    Null texts stay null with no lines; an empty text has one empty line and stays. A document whose lines all go keeps
    its row with an empty text. Columns of ``docs`` named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    did, h, dropped = fresh(docs, "did", "h", "dropped")
    gone = duplicate_lines(docs.select("doc_id", "text"), max_edits, min_chars).toDF(did, h, dropped)
    # a document's row of gone is small beside its text: hashed, so that texts need no sorting
    out = docs.join(gone.hint("shuffle_hash"), (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col(did)) & (F.xxhash64("text") == F.col(h)), "left")
    lines = F.split("text", "\n", -1)
    places_ = F.transform(lines, lambda x, i: i)
    kept = F.array_join(F.transform(F.array(lines), lambda x: F.transform(F.array_except(places_, F.col(dropped)), lambda i: F.get(x, i)))[0], "\n")
    names = [F.col(c) if c != "text" else F.when(F.col(dropped).isNull(), F.col("text")).otherwise(kept).alias("text") for c in docs.columns]
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long")
    return out.select(*names, n.alias("n_lines"), F.when(F.col(dropped).isNull(), 0).otherwise(F.size(F.col(dropped))).cast("long").alias("n_dropped"))
