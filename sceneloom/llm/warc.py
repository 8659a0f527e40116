"""WARC records in ZIP-packaged web archives: written, and read back without extraction.

An archive is a ZIP file with stored members ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj`` (one line a record: where its gzip member lies). Reading takes byte ranges only: the tail with the
end record (ZIP64 where its locator is there), the central directory, the local header of a member, the index, and then
the ranges of records; ranges of RANGE_BYTES are dealt over the cluster, so that one large archive is read by many tasks.

Of records with equal payloads of at least REVISIT_BYTES, that with the smallest page_id is a response and the others are
revisit records, which carry no payload but its digest, length and the response's id. Archives are written by tasks into
the shared folder under a name of the attempt and renamed when complete, so that a repeated task leaves a whole archive.

Defined results: a null html is an empty payload; a null url is left out of the record; a null page_id is larger than
any other and refers as others do; rows equal in payload and page_id are all responses if that page_id is the smallest;
an empty table gives no archives and no records.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch

REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
BROADCAST_DIGESTS = 200_000  # of 32 bytes and an id each
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        path = "file://" + os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(path)


# ---- ZIP


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    size: int  # as it lies in the archive
    header: int  # where its local header begins


class Archive:
    """A ZIP archive read by ranges: ``read(offset, length)`` gives bytes of it."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _ends(self) -> tuple[int, int]:
        """Where the central directory begins, and how long it is."""
        start = max(0, self.size - 22 - 0xFFFF)
        tail = self.read(start, self.size - start)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP archive, or cut short")
        length, offset = struct.unpack_from("<II", tail, at + 12)
        there = start + at - 20
        locator = self.read(there, 20) if there >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            wide = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator leads to no ZIP64 end record")
            length, offset = struct.unpack_from("<QQ", wide, 40)
        return offset, length

    def _directory(self) -> Iterator[Member]:
        offset, length = self._ends()
        raw, at = self.read(offset, length), 0
        while at + 46 <= len(raw) and raw[at : at + 4] == b"PK\x01\x02":
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, full, n, x, c = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = raw[at + 46 + n : at + 46 + n + x], 0
            while e + 4 <= len(extra):
                kind, size = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, e + 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                e += 4 + size
            yield Member(name, method, flags, packed, header)
            at += 46 + n + x + c
        if at != length:
            raise ValueError("the central directory is damaged")

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        m = self.members[name]
        if m.method or m.flags & 1:
            raise ValueError(f"{name} is compressed or encrypted: ranges of it can't be read")
        head = self.read(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        n, x = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + n + x

    def stored(self, name: str) -> bytes:
        return self.read(self.start(name), self.members[name].size)


def opened(path: str):
    """The archive at a path, and the file to close."""
    where, at = filesystem(path)
    file = where.open_input_file(at)

    def read(offset: int, length: int) -> bytes:
        return file.read_at(length, offset)

    return Archive(read, file.size()), file


# ---- WARC


def header(lines: list[tuple[str, str | int | None]]) -> bytes:
    return b"".join(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n".encode() for k, v in lines if v is not None)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\n" + header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http + (payload if kind == "response" else b"")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + header(lines) + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple:
    """page_id, url, payload (None for a revisit), its length, its digest, type, refers_to of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    http, _, payload = rest[: int(field["content-length"])].partition(b"\r\n\r\n")
    inner = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    kind, length, digest = field["warc-type"], int(inner["content-length"]), field["warc-payload-digest"].removeprefix("sha256:")
    refers = number(field["warc-refers-to"]) if kind == "revisit" else None
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if len(payload) != length or found != digest:
            raise ValueError(f"the payload of {field['warc-record-id']} is damaged")
    return number(field["warc-record-id"]), field.get("warc-target-uri"), payload if kind == "response" else None, length, digest, kind, refers


def member(raw: memoryview, at: int, step: int = 16384) -> tuple[bytes, int]:
    """The gzip member that begins at ``at``, unpacked, and where the next one begins."""
    gz, parts = zlib.decompressobj(wbits=31), []
    while not gz.eof:
        if at >= len(raw):
            raise ValueError("a record is cut short")
        parts.append(gz.decompress(raw[at : at + step]))
        at = min(len(raw), at + step) - len(gz.unused_data)
    return b"".join(parts), at


# ---- Spark


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, kind, refers_to.

    Only digests shuffle, partly counted. The repeated ones are broadcast up to BROADCAST_DIGESTS of them, so that payloads
    stay where they are; beyond that payloads meet them by a plain shuffle, whose hot keys Spark splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = p.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("same"), "first")
    groups = cut(groups)
    if groups.count() <= BROADCAST_DIGESTS:
        groups = F.broadcast(groups)
    j = p.join(groups, p["digest"] == groups["same"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


class _Writer:
    def __init__(self, folder: str, part: int, attempt: int):
        self.where, self.folder = filesystem(folder)
        self.name, self.made = f"{self.folder}/part-{part:06d}", 0
        self.attempt, self.zip = attempt, None

    def _open(self) -> None:
        self.where.create_dir(self.folder, recursive=True)
        self.at = f"{self.name}-{self.made:04d}.wacz"
        self.sink = self.where.open_output_stream(f"{self.at}.{self.attempt}.tmp")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.offset, self.index = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []

    def add(self, page_id, url, payload, digest, kind, refers_to) -> None:
        if self.zip is None:
            self._open()
        packed = gzip.compress(record(page_id, url, payload, digest, kind, refers_to), 3, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"id": page_id, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index) + "\n")
        self.zip.close()
        self.sink.close()
        self.where.move(f"{self.at}.{self.attempt}.tmp", self.at)
        out = (self.at, len(self.index), self.offset)
        self.zip, self.made = None, self.made + 1
        return out


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes what ``decided`` gives into archives under folder; returns archive, records, bytes, one row an archive."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, done = _Writer(folder, context.partitionId(), context.taskAttemptId()), []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "kind", "refers_to")), strict=True):
                writer.add(*(x.as_py() for x in row))
                if writer.offset >= ARCHIVE_BYTES:
                    done.append(writer.close())
        if writer.zip is not None:
            done.append(writer.close())
        for archive, n, size in done:
            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n]), pa.array([size])], ["archive", "records", "bytes"])

    return cut(records.mapInArrow(pack, "archive string, records long, bytes long"))


def read(spark: SparkSession, archives: DataFrame, root: str) -> DataFrame:
    """archives(archive): the records in them: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    ``root`` is any URI of the file system that the archives are in.
    """
    scheme = root.partition("://")[0] + "://" if "://" in root and not root.startswith("file:") else ""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                archive, file = opened(scheme + path)
                with file:
                    start, first, length = archive.start(DATA), None, 0
                    ranges = []
                    for line in archive.stored(INDEX).splitlines():
                        at = json.loads(line)
                        if first is None or length + at["length"] > RANGE_BYTES:
                            if first is not None:
                                ranges.append((first, length))
                            first, length = start + at["offset"], 0
                        length += at["length"]
                    if first is not None:
                        ranges.append((first, length))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ranges), pa.string()), pa.array([r[0] for r in ranges], pa.int64()), pa.array([r[1] for r in ranges], pa.int64())], ["archive", "first", "length"])

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, at = filesystem(scheme + row["archive"])
                with where.open_input_file(at) as file:
                    raw, at, out, size = memoryview(file.read_at(row["length"], row["first"])), 0, [], 0
                while at < len(raw):
                    one, at = member(raw, at)
                    out.append(parsed(one))
                    size += len(one)
                    if size > RANGE_BYTES or at >= len(raw):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], names)
                        out, size = [], 0

    ranges = cut(archives.select("archive").repartition(max(1, min(1024, archives.count()))).mapInArrow(plan, "archive string, first long, length long"))
    dealt = ranges.repartition(max(1, min(100_000, ranges.count())))
    return dealt.mapInArrow(fetch, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for each page and reads the archives back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    return read(spark, write(decided(pages), folder), folder)
