"""Identifiers and names that are derived from entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def entry_id(hwids: Column, version: Column, arch: Column, category: Column) -> Column:
    """drv- and 16 hex digits over the sorted ids, version, arch and lower-cased category, all joined by pipes."""
    parts = F.concat(F.array_sort(hwids), F.array(_text(version), _text(arch), F.lower(_text(category))))
    return F.concat(F.lit("drv-"), F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 16))


def installer_id(sha256: Column) -> Column:
    return F.concat(F.lit("inst-"), F.substring(F.sha2(sha256, 256), 1, 12))


def slug(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), F.lit("-"))


def category_file(category: Column) -> Column:
    kept = F.regexp_replace(_text(category), r"[^A-Za-z0-9]", "")
    return F.concat(F.lit("manifests/"), F.when(kept == "", "Other").otherwise(kept), F.lit(".manifest.json"))


def legacy_id(pack: Column, stem: Column, version: Column, arch: Column) -> Column:
    return F.concat_ws("-", slug(pack), slug(stem), slug(F.when(_text(version) == "", "noversion").otherwise(version)), slug(arch))


def legacy_name(names: Column, provider: Column, klass: Column, stem: Column) -> Column:
    """The first device name (64 characters), else provider, class and [stem], and shorter forms as parts are missing."""
    first = F.get(names, F.lit(0))
    p, c = _text(provider), _text(klass)
    return (
        F.when(_text(first) != "", F.substring(first, 1, 64))
        .when((p != "") & (c != ""), F.concat(p, F.lit(" "), c, F.lit(" ["), stem, F.lit("]")))
        .when(p != "", F.concat(p, F.lit(" ["), stem, F.lit("]")))
        .otherwise(F.concat(F.when(c != "", c).otherwise("Driver"), F.lit(" -- "), stem))
    )


def signature(hwids: Column, version: Column, arch: Column, category: Column) -> Column:
    return F.concat_ws("::", F.array_join(F.array_sort(hwids), "|"), _text(version), _text(arch), _text(category))


def group_key(hwids: Column, arch: Column, category: Column) -> Column:
    return F.concat_ws("|", _text(arch), F.lower(_text(category)), F.array_join(F.array_sort(hwids), "|"))


def group_key_legacy(hwids: Column, arch: Column, category: Column) -> Column:
    return F.concat_ws("||", F.array_join(F.array_sort(hwids), "|"), _text(arch), F.lower(_text(category)))


def archive_stem(provider: Column, category: Column, arch: Column, version: Column) -> Column:
    """Short archive name: 8 letters of the provider, 4 of the category, arch, and 10 characters of the version if it has any."""
    word = lambda c, n, default: F.coalesce(F.nullif(F.substring(F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9]", ""), 1, n), F.lit("")), F.lit(default))
    a = F.lower(F.coalesce(F.nullif(arch, F.lit("")), F.lit("x64")))
    short = F.when(a == "amd64", "x64").when(a == "arm64", "a64").otherwise(F.substring(a, 1, 3))
    ver = F.regexp_replace(F.trim(_text(version)), r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*,\s*", "")
    ver = F.rtrim(F.substring(F.regexp_replace(ver, r"[^0-9.]", ""), 1, 10), F.lit("."))
    return F.concat_ws("-", word(provider, 8, "drv"), word(category, 4, "misc"), short, F.nullif(ver, F.lit("")))


def display_name(descriptions: Column, provider: Column, category: Column, version: Column, driver_id: Column) -> Column:
    """The first description, else the non-empty of provider, category and version, else the id."""
    words = F.array_join(F.filter(F.array(provider, category, version), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    return F.coalesce(F.nullif(F.get(descriptions, F.lit(0)), F.lit("")), F.nullif(words, F.lit("")), driver_id)
