"""Version strings as comparable arrays of numbers, in the three readings that the catalog knows; driver dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATED = r"^\d{1,2}/\d{1,2}/\d{4}\s*,\s*(.+)$"


def _long(x: Column) -> Column:
    return x.cast("long")


def version_digits(v: Column) -> Column:
    """Reading A: all digit runs, after a leading v and a date before a comma are left off; [0] if there are none."""
    s = F.regexp_replace(F.trim(F.coalesce(v, F.lit(""))), r"^[vV]", "")
    s = F.when(s.rlike(_DATED), F.trim(F.regexp_extract(s, _DATED, 1))).otherwise(s)
    found = F.transform(F.regexp_extract_all(s, F.lit(r"([0-9]+)"), F.lit(1)), _long)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("long")))


def version_pieces(v: Column) -> Column:
    """Reading B: pieces between dots, commas and dashes that are digits alone, after a date is left off."""
    s = F.regexp_replace(F.coalesce(v, F.lit("")), r"^\d{1,2}/\d{1,2}/\d{4}\s*,\s*", "")
    pieces = F.transform(F.split(s, r"[.,-]"), lambda x: F.trim(x))
    return F.transform(F.filter(pieces, lambda x: x.rlike(r"^[0-9]+$")), _long)


def version_chunks(v: Column) -> Column:
    """Reading C: chunks between dots up to a dash or plus, the digits of each (0 without); a leading v is left off."""
    s = F.regexp_replace(F.trim(F.coalesce(v, F.lit(""))), r"^[vV]+", "")
    s = F.translate(F.substring_index(F.substring_index(s, "-", 1), "+", 1), "_", ".")
    digits = F.transform(F.split(s, r"\."), lambda x: F.regexp_replace(x, r"[^0-9]", ""))
    return F.transform(digits, lambda x: F.when(x == "", F.lit(0)).otherwise(x.cast("long")).cast("long"))


def compare(a: Column, b: Column) -> Column:
    """1, 0 or -1 for number arrays: the first difference decides, else the longer is newer."""
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def compare_padded(a: Column, b: Column) -> Column:
    """As ``compare`` with the shorter array filled up by zeros, so 1.2 equals 1.2.0."""
    n = F.greatest(F.size(a), F.size(b))
    fill = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), n - F.size(x)))
    return compare(fill(a), fill(b))


def driver_date(s: Column) -> Column:
    """struct<y, m, d> of M/D/YY or M/D/YYYY (two digits below 70 are of this century), else null; the calendar isn't checked."""
    pattern = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2,4})\s*$"
    part = lambda i: F.regexp_extract(s, pattern, i).try_cast("int")
    y = part(3)
    year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.when(s.rlike(pattern), F.struct(year.alias("y"), part(1).alias("m"), part(2).alias("d")))


def local_newer(lv: Column, ld: Column, rv: Column, rd: Column) -> Column:
    """Whether a local driver is newer: by padded version, and by date where versions tie and both dates can be read."""
    c = compare_padded(version_chunks(lv), version_chunks(rv))
    a, b = driver_date(ld), driver_date(rd)
    return F.when(c != 0, c > 0).otherwise(F.coalesce(a > b, F.lit(False)))
