"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, only, read, small_batches
from .files import read_files, write_files

# Fixed values of the Zstandard seekable format.
SKIPPABLE, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, b"\xb1\xea\x92\x8f"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that reading hands to Spark at once.
FLUSH_ROWS = 256


@dataclass(frozen=True)
class Bundles:
    """Records with equal payloads of at least min_bytes are stored once. A frame closes at frame_bytes, a bundle at bundle_bytes."""

    min_bytes: int = 0
    frame_bytes: int = 128 << 10
    bundle_bytes: int = 32 << 20
    date: str = "1970-01-01T00:00:00Z"
    level: int = 3


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    found = identifier[len("<urn:x-page:") : -1]
    return None if found == "null" else int(found)


def record(page_id, url, payload: bytes, refers_to, revisit: bool, b: Bundles) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {b.date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """A file in the making: frames, then a skippable frame that maps record identifiers, then the seek table."""

    def __init__(self, b: Bundles):
        self.b, self.pack = b, zstandard.ZstdCompressor(level=b.level)
        self.frames, self.table, self.index, self.open, self.size, self.stored = [], [], [], [], 0, 0

    def add(self, page_id, data: bytes) -> None:
        self.index.append(f"{record_id(page_id)} {len(self.table)} {self.size}\n")
        self.open.append(data)
        self.size += len(data)
        if self.size >= self.b.frame_bytes:
            self.close()

    def close(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), self.size))
            self.stored += len(frame)
            self.open, self.size = [], 0

    def blob(self) -> bytes:
        """The file without the closing magic."""
        self.close()
        index = self.pack.compress("".join(self.index).encode())
        self.frames.append(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        self.table.append((len(index) + 8, 0))
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IB", len(self.table), 0)


def _bundles(b: Bundles):
    def run(batches):
        part, bundle = TaskContext.get().partitionId(), Bundle(b)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([bundle.blob()], pa.binary())], names=["shelf", "blob"])

        for batch in batches:
            for page, url, payload, top, revisit in zip(*(column(batch, c) for c in ("page_id", "url", "html", "top", "revisit")), strict=True):
                page = page.as_py()
                bundle.add(page, record(page, url.as_py(), (payload.as_py() or "").encode(), top.as_py(), revisit.as_py(), b))
                if bundle.stored >= b.bundle_bytes:
                    yield out()
                    bundle = Bundle(b)
        if bundle.index:
            yield out()

    return run


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, stored bytes, bytes) of each frame of a file, from its footer."""
    if content[-4:] != SEEK_MAGIC:
        raise ValueError("no seekable Zstandard footer")
    frames, flags = struct.unpack("<IB", content[-9:-4])
    if flags & 0x80:
        raise ValueError("seek tables with checksums aren't written here")
    at, out = 0, []
    for i in range(frames):
        stored, size = struct.unpack_from("<II", content, len(content) - 9 - 8 * (frames - i))
        out.append((at, stored, size))
        at += stored
    return out


def entries_of(content: bytes, table: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(record identifier, frame, offset in it) of every record, in the order of the file."""
    at, stored, _ = table[-1]
    lines = zstandard.ZstdDecompressor().decompress(content[at + 8 : at + stored]).decode().splitlines()
    return [(i, int(f), int(o)) for i, f, o in (x.split(" ") for x in lines)]


def index_of(content: bytes) -> dict[str, tuple[int, int]]:
    """Record identifier: (frame, offset in it). Of records with one identifier the last counts."""
    return {i: (f, o) for i, f, o in entries_of(content, seek_table(content))}


def parse(data: bytes, at: int = 0):
    """(header, block, end) of the record at an offset of a frame."""
    stop = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    return head, data[begin:end], end + 4


def fetch(content: bytes, identifier: str):
    """(header, block) of one record: its frame alone is read."""
    frame, offset = index_of(content)[identifier]
    at, stored, _ = seek_table(content)[frame]
    return parse(zstandard.ZstdDecompressor().decompress(content[at : at + stored]), offset)[:2]


def _located(content: bytes):
    """(header, block) of every record, each found by its identifier's frame and offset; a frame is unpacked once. The
    records must fill their frames, and the map must lead to the record that it names."""
    unpack, table = zstandard.ZstdDecompressor(), seek_table(content)
    frame, data, end = -1, b"", 0
    for identifier, number, offset in entries_of(content, table):
        if number != frame:
            if end != len(data) or number != frame + 1:
                raise ValueError(f"{identifier}: the map leaves records out")
            at, stored, _ = table[number]
            frame, data, end = number, unpack.decompress(content[at : at + stored]), 0
        if offset != end:
            raise ValueError(f"{identifier}: the map leaves records out")
        head, block, end = parse(data, offset)
        if head["WARC-Record-ID"] != identifier:
            raise ValueError(f"{identifier}: the map leads to {head['WARC-Record-ID']}")
        yield head, block
    if end != len(data) or frame != len(table) - 2:
        raise ValueError("the map leaves records out")


def _records(batches):
    for batch in batches:
        for value in column(batch, "content"):
            rows = []
            for head, block in _located(value.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = head["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{head['WARC-Record-ID']}: the payload differs from its digest")
                rows.append((page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), n, digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
                if len(rows) == FLUSH_ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def write_warc(pages: DataFrame, b: Bundles = Bundles()) -> str:
    """Writes pages (page_id, url, html) as seekable bundles and returns their folder.

    Of equal payloads of min_bytes or more, rows with the largest page_id are responses and the others revisit it (all
    rows of that page_id, where it is repeated). Null html is an empty payload, a null url no target; a null page_id
    counts as the smallest. The decision is made on digests alone, so no payload goes to the task of a hot digest.
    """
    small_batches(pages.sparkSession)
    pages = only(pages, "page_id", "url", "html")
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.withColumn("digest", F.unhex(F.sha2(body, 256)))
    keys = pages.where(F.octet_length(body) >= b.min_bytes).select("page_id", "digest")
    tops = keys.groupBy("digest").agg(F.max("page_id").alias("top"))
    again = keys.distinct().join(tops, "digest").where("page_id < top or page_id is null and top is not null").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "top")
    rows = pages.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", "html", "top", F.col("top").isNotNull().alias("revisit"))
    return write_files(rows.mapInArrow(_bundles(b), "shelf long, blob binary"), "warc", SEEK_MAGIC)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload): a row per record, found by the
    files' maps of identifiers. A map that leaves a record out, or leads to another one, is an error."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return read_files(spark, path).mapInArrow(_records, schema)


def op7_warc(spark, sf_dir):
    path = write_warc(read(spark, sf_dir, "pages"))
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') as t from pages
), g as (select page_id, t, sha1(t) as h, max(page_id) over (partition by sha1(t)) as top from p
), v as (
    select page_id, list_transform(range(0, 8), lambda q: list_reduce(list_transform(range(1, 6), lambda k: instr('0123456789abcdef', substr(h, 5 * q + k, 1)) - 1), lambda x, y: 16 * x + y)) as fives from g
), s as (
    select page_id, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + i // 4] >> (15 - 5 * (i % 4))) & 31), 1)), '') as digest from v
)
select g.page_id, cast(strlen(t) as bigint) as payload_bytes, digest as payload_digest, case when g.page_id = top then 'response' else 'revisit' end as record_type,
    case when g.page_id = top then null else top end as refers_to
from g join s using (page_id)
"""
