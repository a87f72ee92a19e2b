"""Portable executables: sections, the resource tree, version resources and icons, in plain Python over a file's bytes.

Files may be cut short or made to mislead: every read is checked, a directory is entered once, and what can't be read is blank.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

# fixed values of the file format
ICON, VERSION = 3, 16
FIXED_INFO = 0xFEEF04BD
DIRECTORY = 0x80000000
#: Entries of a directory that are looked at, of the tree in all: more than any real file has.
MOST_ENTRIES = 65536


@dataclass
class Node:
    """A block of a version resource: its key, where its value is, and where its children are."""

    key: str
    value: int
    value_units: int
    is_text: bool
    children: int
    end: int


class Image:
    """An executable's resources by kind."""

    def __init__(self, data: bytes):
        self.data = data
        self.root = self.rva = 0
        head = self.number(0x3C, 4)
        if data[:2] != b"MZ" or head is None or data[head : head + 4] != b"PE\0\0":
            return
        sections, optional = self.number(head + 6, 2), self.number(head + 20, 2)
        kind = self.number(head + 24, 2)
        if None in (sections, optional, kind):
            return
        table = head + 24 + (112 if kind == 0x20B else 96)  # the data directories
        rva, size = self.number(table + 16, 4), self.number(table + 20, 4)  # the third is that of resources
        if not rva or not size:
            return
        for k in range(sections):
            at = head + 24 + optional + 40 * k
            start, length, raw = self.number(at + 12, 4), self.number(at + 8, 4), self.number(at + 20, 4)
            stored = self.number(at + 16, 4)
            if raw is None:
                return
            if start <= rva < start + max(length, stored):
                self.root, self.rva = raw + rva - start, rva
                return

    def number(self, at: int, size: int) -> int | None:
        part = self.data[at : at + size]
        return int.from_bytes(part, "little") if at >= 0 and len(part) == size else None

    def entries(self, at: int) -> Iterator[tuple[int, int]]:
        """(id, offset) of a directory's entries."""
        named, numbered = self.number(at + 12, 2), self.number(at + 14, 2)
        if numbered is None:
            return
        for k in range(named + numbered):
            ident, offset = self.number(at + 16 + 8 * k, 4), self.number(at + 20 + 8 * k, 4)
            if offset is None:
                return
            yield ident, offset

    def resource(self, kind: int) -> int | None:
        """Where the first resource of a kind is in the file."""
        if not self.root:
            return None
        left = [offset for ident, offset in self.entries(self.root) if ident == kind][::-1]
        seen, budget = {self.root}, MOST_ENTRIES
        while left and budget > 0:
            budget -= 1
            offset = left.pop()
            at = self.root + (offset & ~DIRECTORY)
            if not offset & DIRECTORY:
                rva = self.number(at, 4)
                found = None if rva is None else self.root + rva - self.rva
                if found is not None and 0 < found < len(self.data):
                    return found
            elif at not in seen:
                seen.add(at)
                left += [o for _, o in self.entries(at)][::-1]
        return None

    def node(self, at: int, end: int) -> Node | None:
        """The version block at a place, if it lies before ``end``."""
        length, units, text = (self.number(at + 2 * k, 2) for k in range(3))
        if text is None or length < 6 or at + length > end:
            return None
        stop = at + 6
        while stop + 2 <= at + length and self.data[stop : stop + 2] != b"\0\0":
            stop += 2
        key = self.data[at + 6 : stop].decode("utf-16-le", "replace")
        value = stop + 2 + (-(stop + 2 - at)) % 4
        size = units * (2 if text == 1 else 1)
        return Node(key, value, units, text == 1, value + size + (-(value + size - at)) % 4, at + length)

    def children(self, node: Node) -> Iterator[Node]:
        at = node.children
        while at < node.end:
            child = self.node(at, node.end)
            if child is None:
                return
            yield child
            at = child.end + (-(child.end - node.children)) % 4

    def version(self) -> tuple[str, str, dict[str, str]]:
        """(file version, product version, strings) of the version resource."""
        at = self.resource(VERSION)
        top = None if at is None else self.node(at, len(self.data))
        if top is None:
            return "", "", {}
        fixed = self.data[top.value : top.value + 24]
        numbers = struct.unpack("<6I", fixed) if len(fixed) == 24 else (0,) * 6
        dotted = lambda hi, lo: f"{hi >> 16}.{hi & 0xFFFF}.{lo >> 16}.{lo & 0xFFFF}"
        known = numbers[0] == FIXED_INFO
        strings: dict[str, str] = {}
        for info in self.children(top):
            if info.key == "StringFileInfo":
                # its value is empty: tables follow the key
                info.children = info.value
                for table in self.children(info):
                    table.children = table.value
                    for entry in self.children(table):
                        raw = self.data[entry.value : min(entry.value + 2 * entry.value_units, entry.end)]
                        strings.setdefault(entry.key, raw.decode("utf-16-le", "replace").split("\0")[0].strip())
        return dotted(*numbers[2:4]) if known else "", dotted(*numbers[4:6]) if known else "", strings

    def icon_hash(self) -> str:
        """The head of a digest of the first icon's first 256 bytes."""
        at = self.resource(ICON)
        return "" if at is None else hashlib.sha256(self.data[at : at + 256]).hexdigest()[:16]


FIELDS = ("file_version", "product_version", "company", "description", "icon_sha256")


def metadata(data: bytes | None) -> tuple[str, ...]:
    """``FIELDS`` of an executable, given as bytes or as anything that slices to bytes; blanks for what it doesn't tell, names of 2 to 199 characters only."""
    image = Image(b"" if data is None else data)
    file_version, product_version, strings = image.version()
    names = (strings.get(x, "") for x in ("CompanyName", "FileDescription"))
    return file_version, product_version, *(x if 2 <= len(x) <= 199 else "" for x in names), image.icon_hash()


def sample(file_version: tuple[int, ...], strings: dict[str, str], icon: bytes = b"", wide: bool = True) -> bytes:
    """A small executable with a version resource and an icon, for tests and queries."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)

    def block(key: str, value: bytes, units: int, text: int, children: list[bytes] = ()) -> bytes:
        head = pad(b"\0" * 6 + key.encode("utf-16-le") + b"\0\0")
        body = head + value
        for child in children:
            body = pad(body) + child
        return struct.pack("<3H", len(body), units, text) + body[6:]

    entries = [block(k, (v + "\0").encode("utf-16-le"), len(v) + 1, 1) for k, v in strings.items()]
    a, b, c, d = file_version
    fixed = struct.pack("<6I", FIXED_INFO, 0x10000, a << 16 | b, c << 16 | d, a << 16 | b, c << 16 | d) + b"\0" * 28
    info = block("VS_VERSION_INFO", fixed, len(fixed), 0, [block("StringFileInfo", b"", 0, 1, [block("040904B0", b"", 0, 1, entries)])])
    rva, leaves = 0x1000, [x for x in ((ICON, icon), (VERSION, info)) if x[1]]
    # root, then for each kind a directory of one name and one of one language, then the leaf entries, then the bytes
    size = lambda n: 16 + 8 * n
    first = size(len(leaves))
    dirs, ends, blobs = b"", b"", b""
    base = first + len(leaves) * 2 * size(1)
    data_at = base + 16 * len(leaves)
    root = struct.pack("<12xHH", 0, len(leaves))
    for k, (kind, blob) in enumerate(leaves):
        at = first + k * 2 * size(1)
        root += struct.pack("<II", kind, DIRECTORY | at)
        dirs += struct.pack("<12xHHII", 0, 1, 1, DIRECTORY | at + size(1)) + struct.pack("<12xHHII", 0, 1, 1033, base + 16 * k)
        ends += struct.pack("<4I", rva + data_at + len(blobs), len(blob), 0, 0)
        blobs += pad(blob)
    rsrc = root + dirs + ends + blobs
    optional = struct.pack("<H", 0x20B if wide else 0x10B) + b"\0" * (110 if wide else 94) + struct.pack("<6I", 0, 0, 0, 0, rva, len(rsrc))
    start = 64 + 24 + len(optional) + 40
    section = b".rsrc\0\0\0" + struct.pack("<4I", len(rsrc), rva, len(rsrc), start) + b"\0" * 16
    return b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH12xHH", 0x8664, 1, len(optional), 0) + optional + section + rsrc
