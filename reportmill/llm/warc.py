"""A WARC data source: `spark.read.format("warc")` and `df.write.format("warc")`, and page archives built on it.

Reading plans file partitions of about `partition_bytes` each, takes filters on header columns (record_type, record_id,
target_uri, payload_digest, refers_to) into the scan, parses the headers first, and neither inflates nor decodes the
payload of a record that they rule out, nor any payload with payload=false. Files are record-per-member gzip; the
members carry their lengths in the `sl` extra field, so a reader can step over them. Plain .warc files and gzip
members without that field are read as well.

A write leaves one file a task under a unique name and lists those of the successful attempts in _FILES on commit; a
reader goes by that list, so files of lost or repeated attempts are never seen. All access is by pyarrow.fs URIs.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "_FILES"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value stays on its line."""
    return " ".join(value.split("\r\n")).replace("\r", " ").replace("\n", " ")


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has its HTTP headers only."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member with its compressed and full length in the extra field `sl`."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Stream:
    """Reads ahead in blocks; step() passes over bytes, by a seek where they are not yet read."""

    def __init__(self, file, block: int = 1 << 20):
        self.file, self.block, self.held, self.at = file, block, b"", 0

    def more(self) -> bool:
        data = self.file.read(self.block)
        self.held, self.at = self.held[self.at :] + data, 0
        return bool(data)

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        return self.held[self.at : self.at + n]

    def beyond(self, used: int, n: int) -> bytes:
        """Up to n bytes from `used` on, at least one unless the file ends."""
        while len(self.held) - self.at <= used and self.more():
            pass
        return self.held[self.at + used : self.at + used + n]

    def step(self, n: int) -> None:
        ahead = n - (len(self.held) - self.at)
        if ahead <= 0:
            self.at += n
        else:
            self.held, self.at = b"", 0
            self.file.seek(self.file.tell() + ahead)


def parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def fields(headers: dict[str, str]) -> dict[str, str | None]:
    out = {k: headers.get(v.lower()) for k, v in HEADERS.items()}
    for k in ("record_id", "refers_to"):
        out[k] = out[k].strip("<>") if out[k] else None
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    return out


def http_parts(block: bytes) -> tuple[int | None, int]:
    """The Content-Length that the HTTP head of a block gives, and where its payload begins."""
    if not block.startswith(b"HTTP/"):
        return None, 0
    end = block.find(b"\r\n\r\n")
    end = len(block) if end < 0 else end + 4
    length = parse(block[:end]).get("content-length")
    return int(length) if length and length.isdigit() else None, end


def records(stream: Stream, wanted, payloads: bool) -> Iterator[tuple[dict, int | None, bytes | None]]:
    """Fields, payload length and payload (None where it is not read) of the wanted records."""
    while start := stream.peek(10):
        if start[:2] == b"\x1f\x8b":
            yield from gzip_record(stream, start, wanted, payloads)
        elif start.lstrip(b"\r\n")[:5] == b"WARC/":
            stream.step(len(start) - len(start.lstrip(b"\r\n")))
            n = 4096
            while (end := stream.peek(n).find(b"\r\n\r\n")) < 0:
                if len(stream.peek(n)) < n:
                    raise ValueError("a WARC record ends within its headers")
                n *= 2
            headers = parse(stream.peek(end))
            stream.step(end + 4)
            length = int(headers["content-length"])
            got = fields(headers)
            if wanted(got):
                block = stream.peek(length if payloads else min(length, 1 << 14))
                yield from shaped(got, block, length, payloads)
            stream.step(length)
        elif not start.strip(b"\r\n"):
            stream.step(len(start))
        else:
            raise ValueError(f"not a WARC record: {start!r}")


def shaped(got: dict, block: bytes, length: int, payloads: bool) -> Iterator[tuple[dict, int | None, bytes | None]]:
    said, at = http_parts(block)
    payload = block[at:length] if payloads and got["record_type"] != "revisit" else None
    yield got, said if said is not None else length - at, payload


def gzip_record(stream: Stream, start: bytes, wanted, payloads: bool) -> Iterator[tuple[dict, int | None, bytes | None]]:
    total = None
    if start[3] & 4:
        n = struct.unpack("<H", stream.peek(12)[10:12])[0]
        extra = stream.peek(12 + n)[12:]
        while len(extra) >= 4:
            size = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"sl" and size == 8:
                total = struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + size :]
    inflate = zlib.decompressobj(31)
    held, used = bytearray(), 0

    def inflated(until) -> None:
        """Inflate until the condition holds or the member ends."""
        nonlocal held, used
        while not inflate.eof and not until():
            tail = inflate.unconsumed_tail
            if tail:
                held += inflate.decompress(tail, 1 << 16)
                continue
            data = stream.beyond(used, 1 << 14)
            if not data:
                raise ValueError("a gzip member is cut short")
            used += len(data)
            held += inflate.decompress(data, 1 << 16)

    inflated(lambda: b"\r\n\r\n" in held)
    end = held.find(b"\r\n\r\n")
    headers = parse(bytes(held[:end]))
    got, length = fields(headers), int(headers["content-length"])
    if wanted(got):
        need = end + 4 + (length if payloads else min(length, 1 << 12))
        inflated(lambda: len(held) >= need)
        yield from shaped(got, bytes(held[end + 4 : end + 4 + length]), length, payloads)
    if total is None:  # the member's end is where inflating ends
        while not inflate.eof:
            held = bytearray()
            inflated(lambda: len(held) > 1 << 20)
        total = used - len(inflate.unused_data)
    stream.step(total)


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def listed(path: str) -> list[tuple[str, int]]:
    """Files of an archive folder (or the one file) and their sizes, by _FILES where there is one."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return [(root, info.size)]
    if fs.get_file_info(f"{root}/{FILES}").type == pyarrow.fs.FileType.File:
        with fs.open_input_stream(f"{root}/{FILES}") as f:
            return [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == pyarrow.fs.FileType.File and x.path.endswith((".warc", ".warc.gz")))


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.size = int(options.get("partition_bytes", 32 << 20))
        self.payloads = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)):
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        parts, held, size = [], [], 0
        for path, n in listed(self.path):
            if held and size + n > self.size:
                parts.append(Part(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, Part(held)]

    def wanted(self, got: dict) -> bool:
        for name, kind, value in self.tests:
            x = got[name]
            ok = {"EqualTo": x is not None and x == value, "EqualNullSafe": x == value, "IsNull": x is None, "IsNotNull": x is not None}.get(kind)
            if kind == "In":
                ok = x is not None and x in value
            if kind == "StringStartsWith":
                ok = x is not None and x.startswith(value)
            if not ok:
                return False
        return True

    def read(self, partition):
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        rows, size = [], 0

        def batch():
            return pa.record_batch([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in self.names], self.names)

        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for got, length, payload in records(Stream(file), self.wanted, self.payloads or self.verify):
                    if self.verify and payload is not None and digest(payload) != got["payload_digest"]:
                        raise ValueError(f"{path}: the payload of {got['record_id']} does not have its digest")
                    rows.append(got | {"payload_bytes": length, "payload": payload if self.payloads else None})
                    size += len(rows[-1]["payload"] or b"") + 200
                    if size > 8 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.level = options["path"], int(options.get("level", 3))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.roll = int(options.get("file_bytes", 1 << 30))
        self.overwrite = overwrite

    def write(self, iterator):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files, out, name, size = [], None, "", 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    data = member(record({n: batch.column(n)[i].as_py() for n in ("record_id", "record_type", "refers_to", "target_uri", "payload")}, self.date), self.level)
                    out.write(data)
                    size += len(data)
                    if size > self.roll:
                        out.close()
                        files.append((name, size))
                        out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, size))
        return Written(files)

    def commit(self, messages):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files = [list(f) for m in messages if m for f in m.files]
        if not self.overwrite and fs.get_file_info(f"{root}/{FILES}").type == pyarrow.fs.FileType.File:
            with fs.open_input_stream(f"{root}/{FILES}") as f:
                files = json.loads(f.read()) + files
        with fs.open_output_stream(f"{root}/{FILES}") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


ID = "urn:x-page:"


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of pages(page_id, url, html) to the archive folder.

    Of records with equal payloads of at least min_bytes, that with the largest page_id is a response and the others
    revisit it; smaller ones are all responses. A null html is empty. Rows without page_id revisit like the others, but
    where no row of an equal payload has one, all are responses; rows that repeat the largest page_id are all responses.
    Other columns are ignored.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("key", F.sha2("payload", 256))
    sized = p.filter(F.octet_length("payload") >= min_bytes)
    groups = sized.groupBy("key").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keep IS NOT NULL").drop("n")
    out = p.join(groups, "key", "left")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    uri = lambda c: F.concat(F.lit(ID), c.cast("string"))
    out.select(
        F.coalesce(uri(F.col("page_id")), F.lit(ID)).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, uri(F.col("keep"))).alias("refers_to"),
        F.col("url").alias("target_uri"),
        "payload",
    ).write.format("warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str, payload: bool = False, verify: bool = True) -> DataFrame:
    """The records of an archive by page: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    register(spark)
    r = spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()
    page = lambda c: F.substring(c, len(ID) + 1, 40).try_cast("long")
    return r.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "payload")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PARTS = " || ".join(
    f"substr('{_ALPHABET}', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS keep FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_PARTS} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keep OR keep IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM keep OR keep IS NULL THEN NULL ELSE keep END AS refers_to FROM g
"""
