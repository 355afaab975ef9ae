"""Files of raw token ids with a minimal perfect hash index from document keys to offsets."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, SLICE_BYTES, column, filled, only, read, slices, small_batches, stage
from .files import read_files, write_files
from .text import mix
from .tokens import encoder, vocabulary

# Fixed values of the file format.
MAGIC, END, VERSION = b"SLTI", b"ITLS", 1
U = np.uint64


@dataclass(frozen=True)
class Shards:
    """vocabulary: a file for tokens.encoder(); each document ends with the token end. A shard closes at shard_bytes of ids."""

    vocabulary: str
    end: int = 2
    shard_bytes: int = 4 << 20


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.atleast_1d(np.asarray(seed, np.uint64)) + U(0x51ED270B)))


class PerfectHash:
    """A minimal perfect hash of distinct int64 keys by hash and displace.

    Keys fall into buckets of two on average. The largest buckets choose first: the least seed that sends their keys
    to free slots; a bucket of one key takes a free slot outright (stored as -slot - 1). A key's slot is found in
    constant time; a stored 32-bit fingerprint tells keys that were never put in.
    """

    def __init__(self, seeds: np.ndarray, prints: np.ndarray, salt: int):
        self.seeds, self.prints, self.salt = seeds, prints, salt

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the slot of each key."""
        n, salt = len(keys), 0
        while True:
            out = cls._try(keys, n, salt)
            if out is not None:
                return out
            salt += 1

    @classmethod
    def _try(cls, keys, n, salt):
        buckets = max(1, -(-n // 2))
        home = (_hash(keys, salt) % U(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=buckets)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        seeds, slots, free = np.zeros(buckets, np.int32), np.empty(n, np.int64), np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            own = order[begins[b] : begins[b + 1]]
            for first in range(1, 1 << 20, 256):
                tries = np.arange(first, first + 256, dtype=np.uint64) + U(salt << 32)
                at = (_hash(keys[own][:, None], tries[None, :]) % U(n)).astype(np.int64)
                good = free[at].all(0)
                for i in range(len(own)):
                    for j in range(i):
                        good &= at[i] != at[j]
                if good.any():
                    t = int(np.argmax(good))
                    seeds[b], slots[own] = first + t, at[:, t]
                    free[at[:, t]] = False
                    break
            else:
                return None
        single = np.flatnonzero(sizes == 1)
        rest = np.flatnonzero(free)
        seeds[single] = -rest - 1
        slots[order[begins[single]]] = rest
        out = cls(seeds, np.empty(n, np.uint32), salt)
        out.prints[slots] = out.fingerprint(keys)
        return out, slots

    def fingerprint(self, keys: np.ndarray) -> np.ndarray:
        return (_hash(keys, 0x7F4A7C15) >> U(32)).astype(np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where the fingerprint differs."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        seed = self.seeds[(_hash(keys, self.salt) % U(len(self.seeds))).astype(np.int64)].astype(np.int64)
        moved = (_hash(keys, np.maximum(seed, 0).astype(np.uint64) + U(self.salt << 32)) % U(len(self.prints))).astype(np.int64)
        slot = np.where(seed < 0, -seed - 1, moved)
        return np.where(self.prints[slot] == self.fingerprint(keys), slot, -1)


_HEAD = struct.Struct("<4sIqIIIII")


def shard_blob(number: int, keys: list, ids: list[bytes]) -> bytes:
    """A file without its closing magic: header, the index, keys and offsets, then the raw ids (2 bytes each if all fit).

    keys are in ascending order, none first; the index leads to the first row of a key, and rows of one key stand
    together. Rows without a key are in no index.
    """
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    payload = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(payload) or payload.max() < 1 << 16 else 4
    null = np.array([k is None for k in keys])
    table = np.array([0 if k is None else k for k in keys], np.int64)
    distinct, rows = np.unique(table[~null], return_index=True)
    rows = np.flatnonzero(~null)[rows]
    if len(distinct):
        index, slots = PerfectHash.build(distinct)
    else:
        index, slots = PerfectHash(np.zeros(0, np.int32), np.zeros(0, np.uint32), 0), np.zeros(0, np.int64)
    row_of = np.empty(len(distinct), np.uint32)
    row_of[slots] = rows
    head = _HEAD.pack(MAGIC, VERSION, number, width, len(keys), len(distinct), len(index.seeds), index.salt)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return b"".join([head, index.seeds.tobytes(), index.prints.tobytes(), row_of.tobytes(), offsets.tobytes(), table.tobytes(), null.astype(np.uint8).tobytes(), payload.astype(f"<u{width}").tobytes()])


class Shard:
    """A file that was read: keyed access to its ids."""

    def __init__(self, content: bytes):
        magic, version, self.number, width, n, keyed, buckets, salt = _HEAD.unpack_from(content)
        if magic != MAGIC or version != VERSION or content[-4:] != END:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        seeds, prints, self.row_of = take(np.int32, buckets), take(np.uint32, keyed), take(np.uint32, keyed)
        self.index = PerfectHash(seeds, prints, salt)
        self.offsets, self.keys, self.null = take(np.int64, n + 1), take(np.int64, n), take(np.uint8, n).astype(bool)
        self.payload = take(f"<u{width}", int(self.offsets[-1]))

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 for a key that isn't here."""
        slot = self.index.find(keys)
        row = np.where(slot < 0, 0, self.row_of[slot].astype(np.int64)) if len(self.row_of) else np.zeros(len(keys), np.int64)
        there = (slot >= 0) & (self.keys[row] == keys if len(self.keys) else False)
        return np.where(there, row, -1)

    def ids(self, row: int) -> np.ndarray:
        return self.payload[self.offsets[row] : self.offsets[row + 1]].astype("<u4")


def _shards(s: Shards):
    def run(batches):
        part, n, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        end, own = np.array([s.end], "<u4").tobytes(), encoder(s.vocabulary)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([shard_blob((part << 24) + n, keys, ids)], pa.binary())], names=["shelf", "blob"])

        for batch in batches:
            for rows, _, _ in slices(batch, limit=8 * SLICE_BYTES):
                found = own.encode(filled(column(batch, "text")[rows]))
                for key, value in zip(column(batch, "doc_id")[rows].to_pylist(), found, strict=True):
                    keys.append(key)
                    ids.append(value + end)
                    size += len(value) // 2
                    if size >= s.shard_bytes:
                        yield out()
                        n, keys, ids, size = n + 1, [], [], 0
        if keys:
            yield out()

    return run


def write_ids(docs: DataFrame, s: Shards) -> str:
    """Writes the ids of documents (doc_id, text) in ascending doc_id order, shard after shard; returns the folder.

    A null or blank text is the end token alone. A null doc_id stands before all others. Rows of one doc_id stand
    together, in the order of a hash of their texts.
    """
    spark = docs.sparkSession
    small_batches(spark, 2 * BATCH_ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = only(docs, "doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return write_files(rows.mapInArrow(_shards(s), "shelf long, blob binary"), "ids", END)


def _digests(batches):
    for batch in batches:
        for value in column(batch, "content"):
            shard = Shard(value.as_py())
            rows = shard.rows(shard.keys)
            # of rows with one key, the index leads to the first; rows without a key are reached by position
            ahead = np.arange(len(rows)) - np.maximum.accumulate(np.where(np.concatenate([[True], shard.keys[1:] != shard.keys[:-1]]) if len(rows) else [], np.arange(len(rows)), 0)) if len(rows) else rows
            at = np.where(shard.null, np.arange(len(rows)), rows + ahead)
            if (rows[~shard.null] < 0).any():
                raise ValueError("a key is missing from its index")
            ids = [shard.ids(r) for r in at.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.number] * len(at), pa.int64()), pa.array(shard.keys, mask=shard.null), pa.array(shard.offsets[at]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                names=["shard", "doc_id", "ahead", "n_tokens", "ids_crc32"],
            )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, reached through their indexes.

    start: ids of all documents before it. Totals of shards are summed within a part, totals of parts over parts.
    """
    rows = stage(read_files(spark, path).mapInArrow(_digests, "shard long, doc_id long, ahead long, n_tokens long, ids_crc32 long"), "digests")
    part = F.shiftright("shard", 24)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", part)
    here = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("shard", "part", here.alias("here")).join(parts.select("part", before.alias("before")), "part")
    base = base.select("shard", (F.col("here") + F.col("before")).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def _lookup(wanted: list[int]):
    keys = np.array(wanted, np.int64)

    def run(batches):
        for batch in batches:
            for value in column(batch, "content"):
                shard = Shard(value.as_py())
                rows = shard.rows(keys)
                out = []
                for key, row in zip(wanted, rows.tolist(), strict=True):
                    while 0 <= row < len(shard.keys) and shard.keys[row] == key and not shard.null[row]:
                        out.append((key, shard.ids(row).tolist()))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([i for _, i in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the given keys; each shard answers by its index, without reading other documents' ids."""
    return read_files(spark, path).mapInArrow(_lookup(list(keys)), "doc_id long, ids array<long>")


def op8_token_files(spark, sf_dir):
    path = write_ids(read(spark, sf_dir, "documents"), Shards(vocabulary("word_bpe_49k.json")))
    return read_digests(spark, path)
