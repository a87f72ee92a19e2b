"""Hardware ids: normal form, validity, truncation ladder, query kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import HWID_PREFIXES


def normalize(h: Column, inner: bool = False) -> Column:
    """Trimmed upper case; with ``inner`` white space inside goes too."""
    return F.upper(F.regexp_replace(h, r"\s+", "") if inner else F.trim(h))


def unescape(h: Column) -> Column:
    """Trimmed, with each run of backslashes made one."""
    return F.regexp_replace(F.trim(h), r"\\+", r"\\")


def is_generic(h: Column) -> Column:
    return ~h.contains("&")


def is_valid(h: Column, wide: bool = False) -> Column:
    """A known bus, a backslash, no white space, and well-formed vendor and device parts on PCI and USB.

    The vendor is of four hex digits; with ``wide`` of four or more, as in ids that are made of numbers above 65,535.
    """
    digits = "{4,}" if wide else "{4}"
    u = F.upper(F.trim(h))
    known = F.substring_index(u, "\\", 1).isin(*HWID_PREFIXES)
    pci = ~(F.startswith(u, F.lit("PCI\\")) & u.contains("VEN_")) | u.rlike(rf"^PCI\\VEN_[0-9A-F]{digits}&DEV_[0-9A-F]{{4}}")
    usb = ~(F.startswith(u, F.lit("USB\\")) & u.contains("VID_")) | u.rlike(rf"^USB\\VID_[0-9A-F]{digits}&PID_[0-9A-F]{{4}}")
    return F.coalesce((F.length(u) >= 5) & u.contains("\\") & ~u.rlike(r"[ \t\n\r\x00]") & known & pci & usb, F.lit(False))


def ladder(h: Column) -> Column:
    """The id and its shorter forms, longest first: segments after the bus are taken off one by one."""
    segments = F.array_remove(F.split(F.substring(h, F.instr(h, "\\") + 1, F.length(h)), "&"), "")
    once = F.array(F.struct(F.concat(F.substring_index(h, "\\", 1), F.lit("\\")).alias("bus"), segments.alias("s")))  # a lambda's variable is worked out once, not anew for each step
    steps = F.transform(once, lambda o: F.when(F.size(o["s"]) > 0, F.transform(F.sequence(F.size(o["s"]), F.lit(1), F.lit(-1)), lambda i: F.concat(o["bus"], F.array_join(F.slice(o["s"], 1, i), "&")))))
    return F.when(F.instr(h, "\\") > 0, F.coalesce(F.get(steps, F.lit(0)), F.array(h))).otherwise(F.array(h))


def looks_like_hwid(q: Column) -> Column:
    return q.rlike(r"(?i)VEN_|DEV_|SUBSYS_|\\")


def looks_like_driver_id(q: Column) -> Column:
    return F.trim(q).rlike(r"(?i)^drv-[0-9a-f]{6,}")
