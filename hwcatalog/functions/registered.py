"""The catalog's scalar functions under names for SQL: osa_distance, version_key, hwid_ladder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def osa_distance(a: str | None, b: str | None) -> int | None:
    """Edits between two texts: put in, take out, change, or swap neighbours, each place once."""
    if a is None or b is None:
        return None
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def version_key(v: str | None) -> list[int]:
    """Pieces between dots, commas and dashes that are digits alone, after a date is left off."""
    rest = re.sub(r"^\d{1,2}/\d{1,2}/\d{4}\s*,\s*", "", v or "")
    return [int(p) for p in (x.strip() for x in re.split(r"[.,-]", rest)) if p.isascii() and p.isdigit()]


def hwid_ladder(h: str | None) -> list[str] | None:
    """The id and its shorter forms, longest first."""
    if h is None:
        return None
    bus, slash, rest = h.partition("\\")
    parts = [x for x in rest.split("&") if x]
    return [bus + "\\" + "&".join(parts[:i]) for i in range(len(parts), 0, -1)] if slash and parts else [h]


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``; in batches by Arrow."""
    for f, kind in ((osa_distance, "int"), (version_key, "array<bigint>"), (hwid_ladder, "array<string>")):
        spark.udf.register(f.__name__, F.udf(f, kind, useArrow=True))
