"""Free-text search: criteria, typo-tolerant scores as columns, ranking, paging, and the search service's routing."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CANDIDATE_CAP, DEFAULT_PAGE_SIZE, FIELD_ALIASES, FIELD_WEIGHTS, MATCH_THRESHOLD, MAX_CRITERIA, MAX_PAGE, MAX_PAGE_SIZE, PREFILTER_FIELDS
from ..functions.hwid import ladder, unescape

_PIECE = re.compile(r'-?(?:[a-z0-9_]+:)?"[^"]*"|\S+', re.I)


@dataclass(frozen=True)
class Criterion:
    value: str
    fields: tuple[str, ...] | None = None
    negate: bool = False
    phrase: bool = False


def parse_query(q: str) -> list[Criterion]:
    """At most eight criteria of a query: tokens, "phrases", field:scopes, -negations; repeated ones count once."""
    out: list[Criterion] = []
    for piece in _PIECE.findall(q):
        if len(out) >= MAX_CRITERIA:
            break
        negate = len(piece) > 1 and piece.startswith("-")
        body = piece[1:] if negate else piece
        key, colon, rest = body.partition(":")
        fields = FIELD_ALIASES.get(key.lower()) if colon and key else None
        value = rest if fields else body
        phrase = len(value) >= 2 and value[0] == value[-1] == '"'
        value = (value[1:-1] if phrase else value).strip().lower()
        if not value:
            continue
        phrase = phrase or re.search(r"\s", value) is not None
        if not phrase and re.match(r"v\d", value):
            value = value[1:]
        c = Criterion(value, tuple(fields) if fields else None, negate, phrase)
        if c not in out:
            out.append(c)
    return out


def typo_budget(n: int) -> int:
    """Edits that a token of n characters may be off."""
    return 0 if n <= 3 else 1 if n <= 7 else 2


def osa_distance(token: str, word: Column) -> Column:
    """Optimal string alignment distance (adjacent swaps count one) of a fixed token of up to 62 characters and a column of words.

    Bit-parallel: bit i of a state word belongs to character i of the token.
    """
    m = len(token)
    if not 0 < m <= 62:
        raise ValueError("tokens have 1 to 62 characters")
    place: dict[str, int] = {}
    for i, ch in enumerate(token):
        place[ch] = place.get(ch, 0) | 1 << i
    masks = F.create_map(*(x for ch, b in place.items() for x in (F.lit(ch), F.lit(b).cast("long"))))
    full, top = (1 << m) - 1, m - 1
    zero = F.lit(0).cast("long")

    def bit(x: Column) -> Column:
        return F.shiftright(x, top).bitwiseAND(F.lit(1).cast("long"))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(s: Column, ch: Column) -> Column:
        keep = lambda x: x.bitwiseAND(F.lit(full).cast("long"))
        inv = lambda x: keep(F.bitwise_not(x))
        eq = F.coalesce(F.element_at(masks, ch), zero)

        def with_eq(e: Column) -> Column:
            swap = F.shiftleft(inv(s["d"]).bitwiseAND(e), 1).bitwiseAND(s["e"])
            d = keep(((e.bitwiseAND(s["p"]) + s["p"]).bitwiseXOR(s["p"])).bitwiseOR(e).bitwiseOR(s["m"]).bitwiseOR(swap))
            return let(F.struct(e.alias("e"), d.alias("d")), with_d)

        def with_d(x: Column) -> Column:
            hp, hm = s["m"].bitwiseOR(inv(x["d"].bitwiseOR(s["p"]))), x["d"].bitwiseAND(s["p"])
            return let(F.struct(x["e"].alias("e"), x["d"].alias("d"), hp.alias("hp"), hm.alias("hm")), last)

        def last(x: Column) -> Column:
            up = keep(F.shiftleft(x["hp"], 1).bitwiseOR(F.lit(1).cast("long")))
            return F.struct(
                keep(F.shiftleft(x["hm"], 1)).bitwiseOR(inv(x["d"].bitwiseOR(up))).alias("p"), up.bitwiseAND(x["d"]).alias("m"),
                x["d"].alias("d"), x["e"].alias("e"), (s["n"] + bit(x["hp"]) - bit(x["hm"])).alias("n"),
            )

        return let(eq, with_eq)

    start = F.struct(F.lit(full).cast("long").alias("p"), zero.alias("m"), zero.alias("d"), zero.alias("e"), F.lit(m).cast("long").alias("n"))
    return F.when(word == "", F.lit(m).cast("long")).otherwise(F.aggregate(F.split(word, ""), start, step, lambda s: s["n"]))


def token_score(token: str, text: Column) -> Column:
    """0 to 100: equal, starts with, contains, a word that starts the token, a word within the typo budget."""
    hay = F.lower(text)
    budget = typo_budget(len(token))
    words = F.filter(F.split(hay, r"[^a-z0-9]+"), lambda w: w != "")

    def score(w: Column) -> Column:
        out = F.when(F.startswith(F.lit(token), w), 88.0) if len(token) >= 3 else F.when(F.lit(False), 88.0)
        if budget and len(token) <= 62:
            near = F.transform(F.array(osa_distance(token, w)), lambda d: F.when(d <= budget, 76.0 - 10.0 * d).otherwise(0.0))
            # a swap is two plain edits, so a word further off than that can't be near; few words are left for the distance with swaps
            close = F.levenshtein(w, F.lit(token), 2 * budget) >= 0
            out = out.when((F.abs(F.length(w) - len(token)) <= budget) & close, F.get(near, F.lit(0)))
        return out.otherwise(0.0)

    return (
        F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(hay == token, 100.0).when(F.startswith(hay, F.lit(token)), 92.0).when(hay.contains(token), 80.0)
        .otherwise(F.coalesce(F.array_max(F.transform(words, score)), F.lit(0.0)))
    )


def phrase_score(phrase: str, text: Column) -> Column:
    """0 to 100: the phrase, the phrase without separators, or every word of it somewhere."""
    flat = re.sub(r"\s+", " ", phrase).strip()
    hay = F.lower(text)
    parts = [token_score(p, hay) for p in flat.split(" ") if p]
    total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    each = F.least(*parts) > 0 if len(parts) > 1 else parts[0] > 0 if parts else F.lit(False)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(hay.contains(flat), 100.0)
        .when(F.regexp_replace(hay, r"[^a-z0-9]+", "").contains(flat.replace(" ", "")), 90.0)
        .when(each, total / max(1, len(parts)) * 0.85).otherwise(0.0)
    )


def _field_score(c: Criterion):
    score = phrase_score if c.phrase else token_score
    return lambda f: score(c.value, f["t"]) * f["w"]


def row_score(criteria: list[Criterion], arrays: tuple[str, ...] = ("descriptions", "os_targets")) -> Column:
    """Sum of the positive criteria's best weighted scores; -1 if one is missing or a negated one is there. Array columns count as JSON text."""
    total, bad = F.lit(0.0), F.lit(False)
    for c in criteria:
        # one expression over an array of the fields, not one a field
        fields = F.array(*(F.struct((F.to_json(n) if n in arrays else F.col(n)).alias("t"), F.lit(1.0 if c.fields else FIELD_WEIGHTS[n]).alias("w")) for n in c.fields or FIELD_WEIGHTS))
        top = F.greatest(F.array_max(F.transform(fields, _field_score(c))), F.lit(0.0))
        if c.negate:
            bad = bad | (top > MATCH_THRESHOLD)
        else:
            bad, total = bad | (top <= MATCH_THRESHOLD), total + top
    return F.when(bad, -1.0).otherwise(total)


def prefilter(criteria: list[Criterion], arrays: tuple[str, ...] = ("descriptions", "os_targets")) -> Column:
    """Rows that have the first four characters of every positive criterion in one of its columns."""
    keep = F.lit(True)
    for c in criteria:
        names = [n for n in PREFILTER_FIELDS if c.fields is None or n in c.fields]
        if c.negate or not names or not c.value[:4]:
            continue
        hit = F.lit(False)
        for n in names:
            hit = hit | F.coalesce(F.lower(F.to_json(n) if n in arrays else F.col(n)).contains(c.value[:4]), F.lit(False))
        keep = keep & hit
    return keep


def facet_filter(df: DataFrame, category: str | None = None, provider: str | None = None, arch: str | None = None, enabled_only: bool = True) -> DataFrame:
    """Equality on the facets given; disabled drivers only on request."""
    if enabled_only:
        df = df.where("enabled")
    for name, value in (("category", category), ("provider", provider), ("arch", arch)):
        if value:
            df = df.where(F.col(name) == value)
    return df


def page_of(page: int | None, size: int | None) -> tuple[int, int]:
    """(offset, limit) within the service's bounds."""
    size = min(MAX_PAGE_SIZE, max(1, size or DEFAULT_PAGE_SIZE))
    return (min(MAX_PAGE, max(1, page or 1)) - 1) * size, size


def _candidates(drivers: DataFrame, criteria: list[Criterion], candidates: str | None, cap: int = CANDIDATE_CAP) -> DataFrame:
    if candidates == "reference":
        return drivers.where(prefilter(criteria)).orderBy(F.desc("updated_at"), "driver_id").limit(cap)
    return drivers


def text_matches(drivers: DataFrame, q: str, candidates: str | None = None, cap: int = CANDIDATE_CAP) -> DataFrame:
    """``text_search`` in no order."""
    criteria = parse_query(q)
    return _candidates(drivers, criteria, candidates, cap).withColumn("score", row_score(criteria)).where("score >= 0")


def text_search(drivers: DataFrame, q: str, candidates: str | None = None, cap: int = CANDIDATE_CAP) -> DataFrame:
    """``drivers`` that match the query, with their score, best first. By default all drivers are scored; candidates="reference" first
    takes the ``cap`` newest that pass the prefilter, as the service does."""
    return text_matches(drivers, q, candidates, cap).orderBy(F.desc("score"), F.desc("enabled"), F.desc_nulls_last("date_added"), "driver_id")


def ranked(found: DataFrame) -> DataFrame:
    """Search results with their rank from 1. Ranges of the order are sorted apart and numbered on from the counts of those before, so no task sees all."""
    from ..sources.scratch import cut, shared_path

    order = [F.desc("score"), F.desc_nulls_last("date_added"), F.asc("driver_id")]
    path = shared_path(found.sparkSession, "ranked")
    found = cut(found, "found")  # scored once, not again for the bounds of the ranges
    # the number of a row tells its range in the upper bits and its place there in the lower 33
    found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = found.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n"))  # one row a range
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(before, "_range").withColumn("rank", rank).drop("_at", "_range", "_before")


def browse(drivers: DataFrame, page: int | None = None, size: int | None = None) -> DataFrame:
    """A page by name, without regard to case."""
    offset, limit = page_of(page, size)
    return drivers.orderBy(F.lower("display_name"), "driver_id").offset(offset).limit(limit)


def hwid_lookup(hwids: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, matched_at, level, exact, driver_id): for each of ``asked`` (query) the drivers of the first rung of its ladder that has any."""
    steps = asked.select("query", F.posexplode(ladder(unescape(F.col("query")))).alias("level", "rung"))
    rows = hwids.select(F.upper("hwid_string").alias("k"), "driver_id")
    # the first rung that is there, told from the ids alone, before any driver of a rung is looked up
    first = steps.join(rows.select("k").distinct(), F.upper("rung") == F.col("k")).groupBy("query").agg(F.min(F.struct("level", "rung")).alias("s")).select("query", "s.level", "s.rung")
    hits = first.join(rows, F.upper("rung") == F.col("k")).dropDuplicates(["query", "driver_id"])
    return hits.select("query", F.col("rung").alias("matched_at"), "level", (F.col("level") == 0).alias("exact"), "driver_id")


def hwid_counts(drivers: DataFrame, hwids: DataFrame) -> DataFrame:
    """``drivers`` with hwid_count, 0 without ids."""
    return drivers.join(hwids.groupBy("driver_id").agg(F.count("*").alias("hwid_count")), "driver_id", "left").withColumn("hwid_count", F.coalesce("hwid_count", F.lit(0)))


def by_ids(drivers: DataFrame, ids: DataFrame, include_disabled: bool = False) -> DataFrame:
    """Drivers in the order of ``ids`` (pos, driver_id)."""
    found = ids.join(drivers, "driver_id")
    return (found if include_disabled else found.where("enabled")).orderBy("pos")


def id_lookup(drivers: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """The driver of that id, or those whose id starts with it, in order, at most ``limit``."""
    key = q.strip()
    exact = drivers.where(F.lower("driver_id") == key.lower())
    started = drivers.where(F.startswith(F.lower("driver_id"), F.lit(key.lower())))
    none = exact.select(F.lit(1).alias("_hit")).limit(1)
    return exact.unionByName(started.join(none, how="left_anti", on=F.lit(True))).orderBy("driver_id").limit(limit)


def read_pages(fetch, size: int = MAX_PAGE_SIZE, most: int = MAX_PAGE) -> DataFrame:
    """All rows of a paged service, with their page: ``fetch(page, size)`` is asked from page 1 on, up to a page that isn't full."""
    out = None
    for page in range(1, most + 1):
        got = fetch(page, size).withColumn("page", F.lit(page))
        out = got if out is None else out.unionByName(got)
        if got.count() < size:
            break
    return out


def _answer(drivers: DataFrame, hwids: DataFrame, q: str, apply_facets: bool, candidates: str | None, facets: dict) -> tuple[str, DataFrame, DataFrame]:
    """(mode, all results in order, rows that were scored) of a query, whichever kind it looks like."""
    q = q.strip()
    kept = facet_filter(drivers, **facets)
    direct = kept if apply_facets else facet_filter(drivers, enabled_only=facets.get("enabled_only", True))
    if q and re.search(r"VEN_|DEV_|SUBSYS_|\\", q, re.I):
        asked = drivers.sparkSession.createDataFrame([(q,)], "query string")
        return "hwid", hwid_lookup(hwids, asked).join(direct, "driver_id").orderBy("driver_id"), direct
    if re.match(r"drv-[0-9a-f]{6,}", q, re.I):
        return "id", id_lookup(direct, q), direct
    criteria = parse_query(q)
    if not any(not c.negate for c in criteria):
        return "browse", kept, kept
    return "text", text_search(kept, q, candidates), _candidates(kept, criteria, candidates)


def search(drivers: DataFrame, hwids: DataFrame, q: str = "", page: int | None = None, size: int | None = None, apply_facets: bool = False, candidates: str | None = None, **facets) -> DataFrame:
    """The search service: hardware ids, driver ids, free text or browsing, whichever the query looks like.

    Hardware-id and driver-id searches look only at enabled_only, as the service's do, unless ``apply_facets``.
    """
    mode, found, _ = _answer(drivers, hwids, q, apply_facets, candidates, facets)
    if mode == "browse":
        return browse(found, page, size)
    offset, limit = page_of(page, size)
    return found.offset(offset).limit(limit)


def envelope(drivers: DataFrame, hwids: DataFrame, q: str = "", page: int | None = None, size: int | None = None, apply_facets: bool = False, candidates: str | None = None, **facets) -> DataFrame:
    """What the service says beside a page of results, in one row: total, page, page_size, mode; and for text how many rows were scored and whether that is the cap."""
    mode, found, scanned = _answer(drivers, hwids, q, apply_facets, candidates, facets)
    offset, limit = page_of(page, size)
    total = found.agg(F.count("*").alias("total"))
    seen = scanned.agg(F.count("*").alias("n"))  # two rows of one
    text = F.lit(mode == "text")
    return total.crossJoin(seen).select(
        "total", F.lit(offset // limit + 1).alias("page"), F.lit(limit).alias("page_size"), F.lit(mode).alias("mode"), F.when(text, F.col("n")).alias("candidates_scanned"),
        F.when(text, (F.lit(candidates == "reference")) & (F.col("n") >= CANDIDATE_CAP)).alias("candidate_cap_hit"),
    )
