"""WARC archives as a PySpark data source.

Reading plans one partition a file, pushes predicates on record types and headers down to the file, parses a
record's headers first and inflates the rest of it only where a wanted record's payload is asked for. Members
of compressed files written here carry their compressed length (the LX extra field of gzip headers), so
an unwanted record is stepped over; members without it are inflated and thrown away, which is all that
the format allows. Uncompressed files are stepped over by Content-Length.

A record whose Content-Length is missing or no number is left out, and so is one that the file's end cuts short: reading goes
on at the next member, or at the next line of an uncompressed file that begins a record. A length header that is no number is null.
"""

from __future__ import annotations

import datetime
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import cut, new_path

SCHEMA = "record_id string, type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, content_type string, content_length long, payload binary"
#: Header of each column. WARC 1.1 has no header for the length of a payload that a revisit leaves out.
HEADERS = {
    "record_id": "WARC-Record-ID", "type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "content_type": "Content-Type", "content_length": "Content-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI (or local path) and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def clean(value: object) -> str:
    """A header value on one line."""
    return "".join(" " if c in "\r\n" else c for c in str(value))


def record_bytes(headers: list[tuple[str, object]], payload: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in headers if v is not None), f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with the LX field: lengths of the member and of what it holds."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"LX" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Buffered:
    """A forward reader of a file with steps over bytes."""

    def __init__(self, f):
        self.f, self.buf, self.at = f, b"", 0

    def need(self, n: int) -> bool:
        """Hold n bytes from here, if the file has them."""
        while len(self.buf) - self.at < n:
            more = self.f.read(max(CHUNK, n))
            if not more:
                return False
            self.buf, self.at = self.buf[self.at :] + more, 0
        return True

    def skip(self, n: int) -> None:
        here = len(self.buf) - self.at
        if n <= here:
            self.at += n
        else:
            self.f.seek(n - here, 1)
            self.buf, self.at = b"", 0


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded value goes on
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def number(value: str | None) -> int | None:
    """A length header's value; None if it is missing or no number."""
    return int(value) if value and value.isascii() and value.isdigit() else None


def _resync(b: Buffered) -> None:
    """To the next line that begins a record, or the file's end."""
    while True:
        at = b.buf.find(b"\nWARC/", b.at)
        if at >= 0:
            b.at = at + 1
            return
        b.at = max(b.at, len(b.buf) - 5)
        if not b.need(len(b.buf) - b.at + 1):
            b.at = len(b.buf)
            return


class Inflated:
    """What a gzip member holds, as a file: read on from the member's beginning in a buffered file, which is left at its end.

    Where its data are damaged it ends there, ``broken``, and the buffered file is left at the damage.
    """

    def __init__(self, b: Buffered):
        self.b, self.z, self.fresh, self.broken = b, zlib.decompressobj(31), True, False

    def read(self, n: int) -> bytes:
        while not self.z.eof and not self.broken:
            feed, tail = self.z.unconsumed_tail, True
            if not feed:
                if not self.b.need(1):
                    return b""  # the file ends within the member
                feed, tail = self.b.buf[self.b.at : self.b.at + CHUNK], False
                self.b.at += len(feed)
            try:
                out = self.z.decompress(feed, n)
            except zlib.error:
                self.broken = True
                self.b.at -= len(feed) - self.fresh
                return b""
            self.fresh = self.fresh and tail
            if self.z.eof:
                self.b.at -= len(self.z.unused_data)
            if out:
                return out
        return b""

    def seek(self, n: int, whence: int) -> None:
        while n > 0 and (x := self.read(min(n, CHUNK))):
            n -= len(x)


def _next_member(b: Buffered) -> None:
    """To what looks like the beginning of a gzip member, or the file's end."""
    while True:
        at = b.buf.find(b"\x1f\x8b\x08", b.at)
        if at >= 0:
            b.at = at
            return
        b.at = max(b.at, len(b.buf) - 2)
        if not b.need(len(b.buf) - b.at + 1):
            b.at = len(b.buf)
            return


def records(f, wanted, payloads: bool, lost: list | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records for which ``wanted(headers)``; payload is None unless ``payloads``.

    Members of a gzip file may hold any number of records, and header lines may end in LF alone. What is damaged is passed over up to the next
    member or record, and told in ``lost``, an entry a place.
    """
    b, lost = Buffered(f), [] if lost is None else lost
    while b.need(1):
        if b.need(14) and b.buf[b.at : b.at + 2] == b"\x1f\x8b" and b.buf[b.at + 3] & 4 and b.buf[b.at + 12 : b.at + 14] == b"LX":
            try:
                yield from _member(b, wanted, payloads)  # one record, as this module writes them
            except zlib.error:
                lost.append("member")
                b.at += 1
                _next_member(b)
        elif b.need(2) and b.buf[b.at : b.at + 2] == b"\x1f\x8b":
            inner = Inflated(b)
            yield from _plain(Buffered(inner), wanted, payloads, lost)
            while inner.read(CHUNK):
                pass
            if inner.broken:
                lost.append("member")
                _next_member(b)
        else:
            yield from _plain(b, wanted, payloads, lost, one=True)


def _head_end(b: Buffered, n: int) -> tuple[int, int]:
    """Where the first n bytes from here have an empty line, and how long the line ends before it are; -1 without one."""
    found = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := b.buf.find(mark, b.at, b.at + n)) >= 0]
    return min(found, default=(-1, 0))


def _plain(b: Buffered, wanted, payloads: bool, lost: list, one: bool = False) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records as they are, up to the end; only the next with ``one``."""
    while b.need(1):
        if b.buf[b.at : b.at + 1] in b"\r\n":
            b.skip(1)
            if one:
                return
            continue
        n = 4096
        while b.need(n) and _head_end(b, n)[0] < 0:
            n *= 2
        end, line = _head_end(b, len(b.buf))
        if end < 0:
            lost.append("head")
            b.at = len(b.buf)
            return
        h = parse_headers(b.buf[b.at : end])
        b.skip(end + line - b.at)
        size = number(h.get("content-length"))
        if size is None:
            lost.append("length")
            b.at = max(0, b.at - 4)
            _resync(b)
        else:
            ok = wanted(h)
            data = None
            if ok and payloads:
                if not b.need(size):
                    lost.append("payload")
                    b.at = len(b.buf)
                    return
                data = b.buf[b.at : b.at + size]
            b.skip(size)
            if ok:
                yield h, data
        if one:
            return


def _member(b: Buffered, wanted, payloads: bool):
    b.need(24)
    at, length = b.at, 0
    if b.buf[at + 3] & 4 and b.buf[at + 12 : at + 14] == b"LX":
        length = struct.unpack("<I", b.buf[at + 16 : at + 20])[0]
    inflate, out, used = zlib.decompressobj(31), b"", 0
    while b"\r\n\r\n" not in out and not inflate.eof:  # headers first
        feed = inflate.unconsumed_tail
        if not feed:
            b.need(used + 1)
            feed = b.buf[b.at + used : b.at + used + 4096]
            used += len(feed)
            if not feed:
                b.skip(used)
                return
        out += inflate.decompress(feed, 8192)
    head, _, rest = out.partition(b"\r\n\r\n")
    h = parse_headers(head)
    size = number(h.get("content-length"))
    ok = size is not None and wanted(h)
    if length and not (ok and payloads):
        b.skip(length)
    else:
        parts = [rest]
        while not inflate.eof:
            feed = inflate.unconsumed_tail
            if not feed:
                b.need(used + 1)
                feed = b.buf[b.at + used : b.at + used + CHUNK]
                used += len(feed)
                if not feed:
                    b.skip(used)
                    return
            more = inflate.decompress(feed, CHUNK)
            if ok and payloads:
                parts.append(more)
        b.skip(used - len(inflate.unused_data))
        rest = b"".join(parts)
    if ok:
        yield h, rest[:size] if payloads else None


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Take equality, membership and prefix tests of header columns; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 else None
            if name in HEADERS and name not in ("payload_length", "content_length"):
                values = f.value if isinstance(f, In) else (f.value,)
                self.tests.append(("start" if isinstance(f, StringStartsWith) else "in", HEADERS[name].lower(), tuple(values)))
            else:
                yield f

    def partitions(self):
        store, path = open_store(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        base = self.path.rstrip("/")
        return [FilePartition(base if info.is_file else base + x.path[len(path.rstrip("/")) :]) for x in sorted(files, key=lambda x: x.path) if x.is_file and x.base_name[0] not in "._"]

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        types = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema.fields])

        def wanted(h: dict[str, str]) -> bool:
            return all((h.get(k) or "").startswith(v[0]) if kind == "start" else h.get(k) in v for kind, k, v in self.tests)

        def value(name: str, h: dict[str, str], data):
            if name == "payload":
                return data
            v = h.get(HEADERS[name].lower())
            if name.endswith("_length"):
                return number(v)
            return v

        if partition is None:
            return
        store, path = open_store(partition.path)
        rows, held = [], 0
        with store.open_input_file(path) as f:
            for h, data in records(f, wanted, "payload" in names):
                rows.append([value(n, h, data) for n in names])
                held += len(data or b"") + 500
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)


def damage(spark: SparkSession, path: str) -> DataFrame:
    """(file, passed_over): how many damaged places a read of each file passes over; files without any aren't listed."""
    files = spark.createDataFrame([(p.path,) for p in WarcReader(StructType([]), {"path": path}).partitions()], "file string")

    def run(batches):
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                store, inner = open_store(name)
                lost: list = []
                with store.open_input_file(inner) as f:
                    for _ in records(f, lambda h: True, True, lost):
                        pass
                if lost:
                    found.append((name, len(lost)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["file", "passed_over"])

    return files.repartition(max(1, min(files.count(), 10_000)), "file").mapInArrow(run, "file string, passed_over long")


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    """A file a task, under a hidden name until the job commits; a lost attempt leaves nothing that is read."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 1))

    def write(self, iterator):
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        with store.open_output_stream(f"{path}/.{name}", compression=None) as f:
            f.write(member(record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", now), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), self.level))
            for batch in iterator:
                for row in batch.to_pylist():
                    revisit = row.get("type") == "revisit"
                    headers = [(HEADERS[k], row.get(k)) for k in HEADERS if k not in ("content_length", "date")] + [("WARC-Date", row.get("date") or now), ("WARC-Profile", REVISIT_PROFILE if revisit else None)]
                    f.write(member(record_bytes(headers, b"" if revisit else row.get("payload") or b""), self.level))
        return Written(name)

    def commit(self, messages):
        store, path = open_store(self.path)
        for m in messages:
            if m is not None:
                store.move(f"{path}/.{m.name}", f"{path}/{m.name}")

    def abort(self, messages):
        store, path = open_store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/.{m.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; a read schema without payload reads headers alone."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write a record per row of ``pages`` (page_id, url, html), the html in UTF-8 as payload (null: empty).

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is a response, the others
    revisit it; smaller ones are all responses. Rows that repeat the smallest page_id are responses too; rows
    without page_id are responses unless a row with one has their payload. Payload digests are gathered by partial
    minima, so large groups of copies don't matter; of the payloads' digests only those that occur twice are joined back.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    heads = rows.where(F.col("payload_length") >= least).groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 AND head IS NOT NULL")
    heads = cut(heads.select(F.col("digest").alias("_d"), "head"), "heads")
    out = rows.join(heads, F.col("digest") == F.col("_d"), "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    records_ = out.select(
        name("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"),
        F.when(revisit, name("head")).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload_length",
        F.lit("text/html; charset=utf-8").alias("content_type"), F.lit(None).cast("long").alias("content_length"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    records_.write.format("warc").mode("append").save(path)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Read archives back: page_id, payload_bytes, payload_digest, record_type, refers_to per page record.

    A response's length and digest are those of the payload as read; a revisit's are what its headers say.
    """
    register(spark)
    pages = spark.read.format("warc").load(path).where(F.col("type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    full = F.col("type") == "response"
    return pages.select(
        number("record_id").alias("page_id"), F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back (see ``archive`` and ``catalog``)."""
    path = new_path(pages.sparkSession, "warc")
    archive(pages, path)
    return catalog(pages.sparkSession, path)
