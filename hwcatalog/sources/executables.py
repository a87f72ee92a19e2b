"""Executables of a folder tree as a Python data source: files are read by offset, never whole.

Of each file the head (for the installer's marks and the section table), then the blocks that the resource tree, the version
resource and the icon lead to are read; so a file costs little, however large it is. Tasks list the tree, level by level, into a table in
the shared folder, and each partition reads the files that one part of that table names: the driver knows the names of its parts alone,
never those of the files. Paths are any that pyarrow can open (``file:``, ``hdfs:``, ``s3:``, ...).
"""

from __future__ import annotations

import functools
import itertools
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from . import pe_image
from .binary_files import INSTALLER_SIGNATURES, LOOK_AT, SEVEN_ZIP
from .scratch import cut, release

SCHEMA = "path string, package string, size long, type string, " + ", ".join(f"{n} string" for n in pe_image.FIELDS) + ", bytes_read long"
#: Files of a partition where ``PARTS`` partitions are enough, and bytes of a block that is read at once.
FILES, BLOCK = 500, 16384
#: Tasks that list a level or read the files at most, and entries of a folder that a task holds at once.
PARTS, ENTRIES = 2000, 10_000
#: Blocks of one file that are read at most; a tree that leads to more is hostile, and what lies beyond reads as empty.
MOST_BLOCKS = 64


class Window:
    """A file as bytes that are read block by block when a slice asks for them."""

    def __init__(self, file, size: int):
        self.file, self.size, self.blocks, self.read = file, size, {}, 0

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            if len(self.blocks) >= MOST_BLOCKS:
                return b""
            self.file.seek(k * BLOCK)
            self.blocks[k] = self.file.read(BLOCK)
            self.read += len(self.blocks[k])
        return self.blocks[k]

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        out = []
        for k in range(start // BLOCK, (stop - 1) // BLOCK + 1):
            block = self._block(k)
            a, b = max(0, start - k * BLOCK), min(BLOCK, stop - k * BLOCK)
            out.append(block[a:b])
            if len(block) < b:  # the file is shorter than it was, or too many blocks were asked for
                break
        return b"".join(out)


def describe(file, size: int) -> tuple:
    """(type, ``pe_image.FIELDS``, bytes read) of an open file; what isn't an executable is ``not-pe`` and has blanks."""
    data = Window(file, size)
    if size < 64 or data[:2] != b"MZ":
        return "not-pe", *("",) * len(pe_image.FIELDS), data.read
    head = data[:LOOK_AT]
    kind = next((name for sign, name in (*INSTALLER_SIGNATURES, (SEVEN_ZIP, "7z-SFX")) if sign in head), "PE-installer")
    return kind, *pe_image.metadata(data), data.read


def package_of(path: str) -> str:
    """The outermost folder of a path below the top, or a file at the top itself."""
    return path.split("/", 1)[0]


def _children(system, top: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path below the top, size, is a folder) of what lies in a folder; a local one is never held as a whole."""
    from pyarrow import fs

    at = f"{top}/{folder}" if folder else top
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                if e.is_dir():
                    yield os.path.join(folder, e.name), 0, True
                elif e.is_file():
                    yield os.path.join(folder, e.name), e.stat().st_size, False
    else:
        for f in system.get_file_info(fs.FileSelector(at)):
            if f.type in (fs.FileType.File, fs.FileType.Directory):
                yield f.path[len(top) :].lstrip("/"), f.size or 0, f.type == fs.FileType.Directory


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, size) of the files below ``path`` that end with ``suffix`` in any case: a table in the shared folder, in parts of like numbers of files.

    Each level of folders is listed by tasks, so names of files never come to the driver. A folder that can't be listed is an error.
    """

    def entries(batches):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(path)
        top = top.rstrip("/")
        for b in batches:
            for folder in b["path"]:
                found = _children(system, top, folder)
                while some := list(itertools.islice(found, ENTRIES)):
                    yield pd.DataFrame(some, columns=["path", "size", "is_dir"])

    levels, folders, n = [], spark.createDataFrame([("",)], "path string"), 1
    while n:
        levels.append(cut(folders.repartition(min(n, PARTS), "path").mapInPandas(entries, "path string, size long, is_dir boolean"), "level"))
        folders = levels[-1].where("is_dir").select("path")
        n = folders.count()
    files = functools.reduce(DataFrame.union, levels).where(~F.col("is_dir") & F.endswith(F.lower("path"), F.lit(suffix.lower()))).select("path", "size")
    out = cut(files.repartition(min(PARTS, max(1, math.ceil(files.count() / FILES))), "path"), "files")
    for level in levels:
        release(level)
    return out


class Part(InputPartition):
    """A part of the listing: its path, none of an empty listing."""

    def __init__(self, path: str | None):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, root: str, listing: str):
        self.root, self.listing, self.package = root, listing, None

    def pushFilters(self, filters: list[Filter]):
        """Of a package asked for by name its own files alone are opened."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("package",) and self.package is None:
                self.package = f.value
            yield f  # Spark asks it again, which costs nothing

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.listing)
        return [Part(f.path) for f in system.get_file_info(fs.FileSelector(top)) if f.path.endswith(".parquet")] or [Part(None)]

    def _listed(self, part: Part) -> Iterator[tuple[str, int]]:
        from pyarrow import fs, parquet

        if part.path is None:
            return
        with fs.FileSystem.from_uri(self.listing)[0].open_input_file(part.path) as file:
            for b in parquet.ParquetFile(file).iter_batches(ENTRIES, columns=["path", "size"]):
                yield from zip(b["path"].to_pylist(), b["size"].to_pylist(), strict=True)

    def read(self, partition: Part) -> Iterator[tuple]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.root)
        for path, size in self._listed(partition):
            if self.package is not None and package_of(path) != self.package:
                continue
            try:
                with system.open_input_file(f"{top.rstrip('/')}/{path}") as file:
                    found = describe(file, size)
            except OSError:  # the file went or can't be opened; its row says so
                found = "unreadable", *("",) * len(pe_image.FIELDS), 0
            yield path, package_of(path), size, *found


class Executables(DataSource):
    """``spark.read.format("executables").option("listing", folder).load(path)``: the files that a stored table of ``list_files`` names."""

    @classmethod
    def name(cls) -> str:
        return "executables"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options["listing"])


def read_executables(spark: SparkSession, path: str, suffix: str = ".exe") -> DataFrame:
    """(path, package, size, type, ``pe_image.FIELDS``, bytes_read) of the executables below ``path``: path and package are below it.

    type is the kind of installer by the first mark in the file's head, ``not-pe`` of files that are no executables, ``unreadable`` of those
    that can't be opened. An empty folder gives no rows. The tree is listed when this is called; files that come later have no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Executables)
    return spark.read.format("executables").option("listing", list_files(spark, path, suffix)._cut_path).load(path)
