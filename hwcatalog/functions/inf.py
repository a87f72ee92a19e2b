"""INF texts as columns: one row a file in, one record a file out, without Python."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HWID_PREFIXES, NT_RELEASES
from .hwid import is_generic, is_valid



_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.translate(text, "\r", "\n"), "\n"), lambda x: F.ltrim(F.translate(x, "\t", " ")))


def _pairs(lines: Column) -> Column:
    """The lines ``key = value`` as structs k (as written) and v."""
    there = F.filter(lines, lambda x: F.instr(x, "=") > 1)
    return F.transform(there, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.ltrim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))


def _section(lines: Column, name: str) -> Column:
    """The lines between a section's first header and the next header: two cuts of the joined text, whatever the number of sections."""
    none = F.array().cast("array<string>")

    def cut(rest: Column, header: Column) -> Column:
        body = F.substring_index(F.substring(rest, header + 1, F.length(rest)), "\n[", 1)
        return F.when(F.substring(rest, header, F.lit(2)) == "\n[", F.array(F.lit(""))).otherwise(F.split(body, "\n"))  # the next header may follow at once

    def within(whole: Column) -> Column:
        at = F.instr(F.translate(whole, _UPPER, _LOWER), f"\n[{name}]")
        after = lambda at: _let(F.substring(whole, at + 1, F.length(whole)), lambda rest: _let(F.instr(rest, "\n"), lambda header: F.when(header > 0, cut(rest, header)).otherwise(none)))
        return _let(at, lambda at: F.when(at > 0, after(at)).otherwise(none))

    return _let(F.concat(F.lit("\n"), F.array_join(lines, "\n")), within)


def _field(pairs: Column, name: str) -> Column:
    value = F.get(F.filter(pairs, lambda p: (F.lower(p["k"]) == name.lower()) & (p["v"] != "")), F.lit(0))["v"]
    return F.coalesce(value if name == "DriverVer" else F.substring_index(value, ";", 1), F.lit(""))


def field(text: Column, name: str) -> Column:
    """First value of a line ``name = value``, up to a semicolon; the version line runs to its end. Blank if there is none."""
    return _field(_pairs(_lines(text)), name)


def _strings(lines: Column) -> Column:
    entries = F.filter(_pairs(_section(lines, "strings")), lambda p: ~p["k"].rlike("[^A-Za-z0-9_.]"))
    quoted = lambda v: F.when(F.startswith(v, F.lit('"')), F.substring_index(F.substring(v, 2, F.length(v)), '"', 1)).otherwise(F.substring_index(v, '"', 1))
    return F.transform(entries, lambda p: F.struct(F.upper(p["k"]).alias("k"), F.trim(quoted(p["v"])).alias("v")))


def strings(text: Column) -> Column:
    """Entries of the [Strings] section: array of (upper-cased key, value), the last of a key counts."""
    return _strings(_lines(text))


def _devices(pairs: Column) -> Column:
    named = lambda p: F.startswith(p["k"], F.lit("%")) & F.endswith(p["k"], F.lit("%")) & (F.length(p["k"]) > 2) & (F.instr(p["v"], ",") > 1)
    found = F.filter(pairs, named)
    return F.filter(F.transform(found, lambda p: F.struct(p["k"].alias("name"), F.trim(F.substring(p["v"], F.instr(p["v"], ",") + 1, F.length(p["v"]))).alias("ids"))), lambda d: d["ids"] != "")


def devices(text: Column) -> Column:
    """Device lines ``%name% = section, id, ...``: structs of the name in its signs and the ids."""
    return _devices(_pairs(_lines(text)))


def resolve(text: Column, table: Column) -> Column:
    """``text`` with each %name% that the table knows replaced, names compared without case; others stay."""
    return _let(F.reverse(table), lambda latest: _resolve(text, latest))


def _resolve(text: Column, latest: Column) -> Column:
    """``resolve`` by a table whose first entry of a key counts."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(%[A-Za-z0-9_.]+%|[^%]+|%)"), F.lit(1))
    named = lambda p, key: F.coalesce(F.get(F.filter(latest, lambda e: e["k"] == key), F.lit(0))["v"], p)

    def value(p: Column) -> Column:
        return F.when(F.startswith(p, F.lit("%")) & (F.length(p) > 1), _let(F.upper(F.btrim(p, F.lit("%"))), lambda key: named(p, key))).otherwise(p)

    return F.trim(F.array_join(F.transform(pieces, value), ""))


def version(text: Column, table: Column) -> Column:
    return _version(field(text, "DriverVer"), table)


def _version(value: Column, table: Column) -> Column:
    raw = resolve(value, table)
    return F.trim(F.when(raw.contains(","), F.regexp_extract(raw, r"(?s)^[^,]*,(.*)$", 1)).otherwise(raw))


def dated_version(raw: Column) -> Column:
    """struct<date, version> of a DriverVer value: with a valid date before a comma MM/DD/YYYY and the rest, else no date and all of it."""
    pattern = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*,\s*(.+?)\s*$"
    m, d, y = (F.regexp_extract(raw, pattern, i).try_cast("int") for i in (1, 2, 3))
    ok = F.coalesce(raw.rlike(pattern) & F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))
    return F.struct(F.when(ok, F.format_string("%02d/%02d/%04d", m, d, y)).otherwise("").alias("date"), F.when(ok, F.regexp_extract(raw, pattern, 4)).otherwise(F.trim(raw)).alias("version"))


def arch(text: Column) -> Column:
    """The most common of the NT architectures, the first seen of equals; x64 without any."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)NT(amd64|x86|arm64)"), F.lit(1)), lambda x: F.lower(x))
    kinds = F.array_distinct(found)
    counted = F.transform(kinds, lambda k, i: F.struct(F.size(F.filter(found, lambda x: x == k)).alias("n"), (-i).alias("p"), k.alias("k")))
    best = F.array_max(counted)["k"]
    return F.coalesce(F.when(best == "amd64", "x64").otherwise(best), F.lit("x64"))


def os_targets(text: Column) -> Column:
    """Releases of the NT versions named, distinct, in order of first mention."""
    pattern = r"(?i)NT(\d+)\.(\d+)(?:\.\d+)?"
    known = F.create_map(*(F.lit(x) for (a, b), name in NT_RELEASES.items() for x in (f"{a}.{b}", name)))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, b: F.concat(a.cast("int").cast("string"), F.lit("."), b.cast("int").cast("string")))
    return F.array_distinct(F.transform(pairs, lambda v: F.coalesce(F.element_at(known, v), F.concat(F.lit("NT "), v))))


def hwids(text: Column, wide: bool = False) -> Column:
    """Valid ids of the text and of its device lines, upper-cased, sorted; ``wide`` as in ``hwid.is_valid``."""
    return _hwids(text, devices(text), wide)


def _hwids(text: Column, found: Column, wide: bool = False) -> Column:
    words = F.split(F.upper(F.translate(text, "\t\r\n,;=\"()[]<>'", "               ")), " ")
    plain = F.filter(words, lambda x: (F.instr(x, "\\") > 1) & F.substring_index(x, "\\", 1).isin(*HWID_PREFIXES))
    listed = F.flatten(F.transform(found, lambda d: F.split(d["ids"], ",")))
    listed = F.filter(F.transform(listed, lambda x: F.upper(F.trim(x))), lambda x: reduce(Column.__or__, (x.contains(part) for part in ("DEV_", "VID_", "PID_", "CC_"))))
    return F.array_sort(F.array_distinct(F.filter(F.array_union(plain, listed), lambda x: is_valid(x, wide))))


def descriptions(text: Column, table: Column) -> Column:
    """Names of the device lines, resolved, distinct, the first ten."""
    return _descriptions(devices(text), table)


def _descriptions(found: Column, table: Column) -> Column:
    name = lambda d: F.concat(F.lit("%"), F.trim(F.btrim(d["name"], F.lit("%"))), F.lit("%"))
    names = _let(F.reverse(table), lambda latest: F.transform(found, lambda d: _resolve(name(d), latest)))
    return F.slice(F.array_distinct(F.filter(names, lambda x: x != "")), 1, 10)


def parse_inf(files: DataFrame, text: str = "text", wide: bool = False) -> DataFrame:
    """``files`` with version, category, provider, arch, os_targets, hwids, compatible_ids and descriptions of their INF text; empty texts are left out; ``wide`` as in ``hwid.is_valid``.

    A text is split once: its lines, then its pairs, then its strings and devices are columns of their own, from which all fields are taken.
    """
    t, table = F.col(text), F.col("_strings")
    out = files.where(F.coalesce(t, F.lit("")) != "").withColumn("_lines", _lines(t))
    out = out.withColumns({"_pairs": _pairs(F.col("_lines")), "_strings": _strings(F.col("_lines"))}).withColumn("_devices", _devices(F.col("_pairs")))
    pairs = F.col("_pairs")
    out = out.withColumns(
        {
            "version": _version(_field(pairs, "DriverVer"), table), "category": resolve(F.trim(_field(pairs, "Class")), table),
            "provider": F.trim(F.regexp_replace(resolve(F.trim(_field(pairs, "Provider")), table), r'[%"]', "")),
            "arch": arch(t), "os_targets": os_targets(t), "hwids": _hwids(t, F.col("_devices"), wide), "descriptions": _descriptions(F.col("_devices"), table),
        }
    )
    return out.withColumn("compatible_ids", F.filter("hwids", is_generic)).drop("_lines", "_pairs", "_strings", "_devices")
