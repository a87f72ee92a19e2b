"""Small text and number functions of the catalog and its tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BUILTIN_PREFIXES, CLASS_TO_TYPE, PROVIDER_SUFFIXES


def normalize_provider(p: Column) -> Column:
    """Lower case without corporate suffix words and marks, single spaces."""
    s = F.regexp_replace(F.lower(F.trim(p)), r"\b(" + "|".join(PROVIDER_SUFFIXES) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]", " "), r" +", " "))


def class_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in CLASS_TO_TYPE.items() for x in pair))


def normalize_class(c: Column, strict: bool = True) -> Column:
    """Type of a setup class; unknown names in lower case. Without ``strict`` a name that is itself a type stands for that type."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    own = F.create_map(*(F.lit(x) for t in sorted(set(CLASS_TO_TYPE.values())) for x in (t.lower(), t)))
    known = F.element_at(class_map(), low)
    return F.coalesce(known, low) if strict else F.coalesce(F.element_at(own, low), known, low)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two id sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def clamp_int(raw: Column, fallback: int, low: int, high: int) -> Column:
    """The leading integer of a text within bounds, or the fallback."""
    n = F.regexp_extract(F.coalesce(raw, F.lit("")), r"^\s*([+-]?\d{1,15})", 1).try_cast("long")
    return F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), n)), F.lit(fallback)).cast("long")


def json_array(s: Column) -> Column:
    """A JSON list of strings, or an empty one."""
    return F.coalesce(F.from_json(s, T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def safe_component(name: Column, default: str = "unnamed") -> Column:
    """A file name: forbidden and control characters become _, dots and spaces at the ends go."""
    s = F.btrim(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(". "))
    return F.when(s == "", default).otherwise(s)


def unique_key(driver_id: Column, basis: Column) -> Column:
    return F.concat(F.substring(safe_component(driver_id), 1, 40), F.lit("-"), F.substring(F.sha1(basis), 1, 8))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit below 1024 of it, with two decimals from KB on; a tie goes to the even digit."""
    x = n.cast("decimal(20,0)")
    # the divisor's seventeen digits give the quotient eighteen places, enough to tell a tie
    amount = lambda i: F.bround(x / F.lit(1024**i).cast("decimal(17,0)"), 2).cast("decimal(30,2)").cast("string")
    out = F.when(x < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = out.when(x < 1024 ** (i + 1), F.concat(amount(i), F.lit(f" {unit}")))
    return out.otherwise(F.concat(amount(5), F.lit(" PB")))


def human_time(s: Column) -> Column:
    """Seconds as 5s, 1m 5s or 2h 3m 4s."""
    n = F.floor(s).cast("long")
    h, m = F.floor(n / 3600).cast("long"), F.floor(n / 60).cast("long")
    return F.when(n < 60, F.format_string("%ds", n)).when(n < 3600, F.format_string("%dm %ds", m, n % 60)).otherwise(F.format_string("%dh %dm %ds", h, m % 60, n % 60))


def is_safe_path(p: Column) -> Column:
    """No absolute path, drive letter or step upwards."""
    norm = F.regexp_replace(p, r"\\", "/")
    return ~norm.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def is_uploadable(original: Column, hwids: Column, provider: Column, category: Column) -> Column:
    """Not a driver that comes with the system, and with ids, a provider or a category to tell it by."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(original, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    builtin = stem.rlike("^(" + "|".join(BUILTIN_PREFIXES) + ")(_|$)")
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return ~builtin & ((F.coalesce(F.size(hwids), F.lit(0)) > 0) | some(provider) | some(category))
