"""Best-fit-decreasing packing of token pieces into windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, filled, only, read, slices, small_batches, stage
from .tokens import encoder, vocabulary


@dataclass(frozen=True)
class Packing:
    """window tokens a sequence; each document ends with the token end. vocabulary: a file for tokens.encoder()."""

    vocabulary: str
    window: int = 1024
    end: int = 0


class Capacities:
    """A segment tree over remaining capacities 0..window: the least capacity of at least x that some open window has."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        at = self.size + capacity
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = self.size + least
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], window: int) -> np.ndarray:
    """Best fit decreasing over piece lengths: rows (length, first rank, pieces a window, first window, used before).

    The pieces of one length are alike, and so are open windows of one capacity, so a step places many at once: the
    tightest window takes pieces of the length until the next doesn't fit, as it stays the tightest meanwhile. The
    result equals placing piece by piece, in steps whose number depends on the lengths and not on the pieces.
    """
    tree, groups, rows, windows = Capacities(window), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            if not groups.get(capacity):
                groups[capacity] = []
                tree.set(capacity, True)
            groups[capacity].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                first, n, capacity = windows, -(-left // each), window
                windows += n
            else:
                first, n = groups[capacity].pop()
                if not groups[capacity]:
                    tree.set(capacity, False)
                each = capacity // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, each, first, window - capacity))
                put(capacity - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                rows.append((length, rank, left, first, window - capacity))
                put(capacity - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(capacity, first, n)
    return np.array(rows, np.int64).reshape(-1, 5)


_PIECE = "part long, doc_id long, start long, length long, doc_tokens long, rank long, ids binary"


def _pieces(p: Packing):
    def run(batches):
        part, ranks = TaskContext.get().partitionId(), np.zeros(p.window + 1, np.int64)
        end = np.array([p.end], "<u4").tobytes()
        for batch in batches:
            for rows, _, _ in slices(batch):
                own = encoder(p.vocabulary)
                docs, starts, sizes, totals, order, ids = [], [], [], [], [], []
                for doc, found in zip(column(batch, "doc_id")[rows].to_pylist(), own.encode(filled(column(batch, "text")[rows])), strict=True):
                    found += end
                    total = len(found) // 4
                    for at in range(0, total, p.window):
                        n = min(p.window, total - at)
                        docs.append(doc)
                        starts.append(at)
                        sizes.append(n)
                        totals.append(total)
                        order.append(ranks[n])
                        ranks[n] += 1
                        ids.append(found[4 * at : 4 * (at + n)])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int64()), pa.array(docs, pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, sizes, totals, order)), pa.array(ids, pa.binary())], names=["part", "doc_id", "start", "length", "doc_tokens", "rank", "ids"])

    return run


def _place(shared):
    def run(batches):
        rows, firsts, begins = shared.value
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy() + column(batch, "before").to_numpy()
            at = np.searchsorted(firsts, begins[length] + rank, "right") - 1
            row = rows[at]
            ahead = rank - row[:, 1]
            yield batch.drop_columns(["rank", "before"]).append_column("sequence_id", pa.array(row[:, 3] + ahead // row[:, 2])).append_column("offset", pa.array(row[:, 4] + ahead % row[:, 2] * length))

    return run


def place(pieces: DataFrame, window: int) -> DataFrame:
    """Rows of (part, length, rank, ...) with sequence_id and offset instead of rank.

    rank counts the pieces of one length within a part. Only a histogram of lengths, at most window rows, goes to the
    driver; the plan that comes back has a row per step of best_fit. A piece's rank over all parts is its rank in its
    part and the count of its length in the parts before.
    """
    sums = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = best_fit(counts, window)
    begins = np.zeros(window + 2, np.int64)  # pieces of one length are numbered after those of all shorter ones
    for length, n in counts.items():
        begins[length + 1] = n
    begins = np.cumsum(begins)
    firsts = begins[rows[:, 0]] + rows[:, 1]
    order = np.argsort(firsts, kind="stable")
    shared = pieces.sparkSession.sparkContext.broadcast((rows[order], firsts[order], begins))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    others = [c for c in pieces.columns if c not in ("part", "rank")]
    rows_in = pieces.join(sums, ["part", "length"]).select(*others, "rank", "before")
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    return rows_in.mapInArrow(_place(shared), ", ".join([*(f"{c} {kinds[c]}" for c in others), "sequence_id long", "offset long"]))


def tokenise(docs: DataFrame, p: Packing) -> DataFrame:
    """The staged pieces of all documents: full windows, and a last piece of what remains."""
    small_batches(docs.sparkSession)
    return stage(only(docs, "doc_id", "text").mapInArrow(_pieces(p), _PIECE), "pieces")


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): a row per piece of documents (doc_id, text).

    A document is its token ids and the end token; an empty or null text is the end token alone. Documents over the
    window are cut into full windows and a rest; every id lies in one piece. Rows with one doc_id, or with none, are
    documents of their own. ids: little-endian unsigned 32-bit.
    """
    return place(tokenise(docs, p), p.window)


def packed_digest(docs: DataFrame, p: Packing) -> DataFrame:
    """pack() with a checksum of the ids instead of the ids, which then don't travel."""
    pieces = tokenise(docs, p).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(pieces, p.window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir):
    return packed_digest(read(spark, sf_dir, "documents"), Packing(vocabulary("byte_bpe_50k.json")))
