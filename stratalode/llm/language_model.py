"""A hierarchical Pitman-Yor language model: a restaurant for each word before, over one of words, over restaurants of
the bytes they are spelt with."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import column, new_path, only, read, release, slices, small_batches, stage

END = b"\n"  # the end of a text as a word: no word holds white space
END_HASH = T.hash_words(np.frombuffer(END, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))[0]
BEGIN_HASH = T.mix(np.array([258], np.uint64))[0]  # the beginning of a text, as a word before only
U = np.uint64


@dataclass(frozen=True)
class Seating:
    """Documents with crc32(doc_id as text) mod folds == fold are held out of training.

    The restaurant of a word before seats the words that follow; its parent, the word restaurant, has its tables as
    customers. The word restaurant's base is a spelling model: a restaurant for every two bytes before, whose parent
    drops the farther byte, down to no byte and a uniform base. Each of sweeps Gibbs sweeps seats the customers of all
    levels again; the states from burn on are averaged. theta: strength of all restaurants; discounts come from how many
    dishes have one customer and two. chunk_bytes of text make a chunk, bucket_bytes of text a bucket's pairs.
    """

    folds: int = 5
    fold: int = 1
    sweeps: int = 2
    burn: int = 1
    byte_sweeps: int = 3
    theta: float = 1.0
    chunk_bytes: int = 16 << 20
    bucket_bytes: int = 24 << 20
    seed: int = 11


def held_out(doc_id, s: Seating) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % s.folds == s.fold


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(values), width) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", blob)
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(pa.decompress(blob[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


_CHUNK = "chunk long, docs array<long>, held binary, size long, words binary, ids binary"


def _index(s: Seating):
    """Chunks of whole texts: the distinct words, the most frequent first, and the words of each text as their numbers."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        held: list = []  # (ids, lower-cased bytes, starts, ends, first, hashes) of the open chunk
        size = 0

        def close():
            docs = sum((x[0] for x in held), [])
            out_of = np.array([held_out(d, s) for d in docs], bool)
            begins = np.cumsum([0, *(len(x[2]) for x in held)])
            hashes = np.concatenate([x.pop() for x in held])
            lengths = np.concatenate([np.diff(x[4]) for x in held])
            _, index, number, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            del hashes
            by_count = np.argsort(-counts, kind="stable")
            rank = np.empty(len(counts), np.int64)
            rank[by_count] = np.arange(len(counts))
            first = index[by_count]
            source = np.searchsorted(begins, first, "right") - 1
            words = b"".join([held[b][1][held[b][2][i] : held[b][3][i]].tobytes() + END for b, i in zip(source.tolist(), (first - begins[source]).tolist(), strict=True)])
            stream = np.full(len(number) + len(docs), len(counts), np.int64)
            there = np.ones(len(stream), bool)
            there[np.cumsum(lengths + 1) - 1] = False
            stream[there] = rank[number]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([out_of.tobytes()], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([pa.compress(words, "zstd", asbytes=True)], pa.binary()), pa.array([pack(stream)], pa.binary())],
                names=["chunk", "docs", "held", "size", "words", "ids"],
            )

        for batch in batches:
            for rows, data, offsets in slices(batch):
                low = T.LOWER[data]
                starts, ends, first = T.words(low, offsets)
                held.append([column(batch, "doc_id")[rows].to_pylist(), low, starts.astype(np.int32), ends.astype(np.int32), first, T.hash_words(low, starts, ends)])
                size += len(low) + 1
                if size >= s.chunk_bytes:
                    yield from close()
                    held, size, n = [], 0, n + 1
        if held:
            yield from close()

    return run


def _split(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words without the sign behind each, and their offsets."""
    data = np.frombuffer(words, np.uint8)
    stops = np.flatnonzero(data == END[0])
    return data[data != END[0]], np.concatenate([[0], stops - np.arange(len(stops))])


class Chunk:
    """A chunk that was read. Words have the numbers 0 to m - 1, END m, and BEGIN, a word before only, m + 1. Where texts
    is false, only the distinct pairs are kept of the words in their order."""

    def __init__(self, size: int, words: bytes, ids: bytes | None = None, texts: bool = True):
        data, offsets = _split(pa.decompress(words, size, "zstd", asbytes=True) if size else b"")
        self.m = len(offsets) - 1
        self.data, self.offsets = np.concatenate([data, np.frombuffer(END, np.uint8)]), np.append(offsets, len(data) + 1)
        self.hashes = np.concatenate([T.hash_words(data, offsets[:-1], offsets[1:]), [END_HASH, BEGIN_HASH]])
        self.width = self.m + 2
        if ids is not None:
            stream = unpack(ids).view(np.int64)
            ends = np.flatnonzero(stream == self.m)
            heads = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            pairs = np.empty(len(stream), np.int64)
            pairs[1:] = stream[:-1]
            pairs[heads] = self.m + 1
            pairs *= self.width
            pairs += stream
            if texts:
                self.heads, self.stream = heads, stream.astype(np.int32)
                self.codes, inverse = np.unique(pairs, return_inverse=True)
                self.inverse = inverse.astype(np.int32)
            else:
                pairs.sort()
                self.codes = pairs[np.diff(pairs, prepend=-1) > 0]

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """A hash of each pair (the word before, the word)."""
        return T.mix(self.hashes[codes // self.width] * U(0xA0761D6478BD642F) + T.mix(self.hashes[codes % self.width]))

    def trained(self, held: bytes) -> np.ndarray:
        """Which words of the stream are of training texts."""
        return np.repeat(~np.frombuffer(held, bool), np.diff(np.append(self.heads, len(self.stream))))


def _order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and where each bucket ends in it; a bucket is a range of keys."""
    order = np.argsort(keys)
    return order, np.searchsorted(((keys[order] >> U(32)) * U(buckets)) >> U(32), np.arange(buckets), "right")


def _parcels(chunk: int, keys: np.ndarray, values: list[np.ndarray], buckets: int):
    """Rows (bucket, chunk, keys, values) in order of the keys."""
    order, stops = _order(keys, buckets)
    keys, values, at = keys[order], [v[order] for v in values], 0
    for bucket, stop in enumerate(stops.tolist()):
        if stop > at:
            own = keys[at:stop].copy()
            own[1:] -= keys[at : stop - 1]
            yield bucket, chunk, pack(own), *(pack(v[at:stop]) for v in values)
        at = stop


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


_OFFER = "bucket long, chunk long, keys binary, a binary"


def _offers(buckets: int):
    """How often each word and each pair of a chunk stands in training texts."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk(r["size"], r["words"], r["ids"])
                trained = chunk.trained(r["held"])
                counts = np.concatenate([np.bincount(chunk.stream[trained], minlength=chunk.m + 1)[: chunk.m + 1], np.bincount(chunk.inverse[trained], minlength=len(chunk.codes))])
                keys = np.concatenate([chunk.hashes[: chunk.m + 1], chunk.keys(chunk.codes)])
                for row in _parcels(r["chunk"], keys, [counts], buckets):
                    yield _batch([row], _OFFER)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Sums over all chunks for the keys of a bucket: 2 * sum, and 1 more for the chunk that owns the key, the first."""
    table = table.sort_by("chunk")
    keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in column_of(table, "keys")]
    counts = np.concatenate([unpack(x.as_py()) for x in column_of(table, "a")]).astype(np.float64)
    _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    sums = np.bincount(inverse, counts).astype(np.uint64)[inverse] * U(2)
    sums[first] += U(1)
    cuts = np.cumsum([0, *map(len, keys)])
    return pa.table({"chunk": column_of(table, "chunk"), "bucket": column_of(table, "bucket"), "a": pa.array([pack(sums[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def column_of(table: pa.Table, name: str):
    return table.column(name).combine_chunks()


def _joined(table: pa.Table, names: str) -> list[np.ndarray]:
    """The values of a chunk's rows (bucket, ...), in order of the buckets."""
    table = table.sort_by("bucket")
    return [np.concatenate([np.empty(0, np.uint64), *(unpack(x.as_py()) for x in column_of(table, name))]) for name in names]


def _counts(chunk: Chunk, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts of words, whether they are the chunk's own, counts of pairs, whether they are)."""
    (found,) = _joined(replies, "a")
    order, _ = _order(np.concatenate([chunk.hashes[: chunk.m + 1], chunk.keys(chunk.codes)]), buckets)
    out = np.empty(len(found), np.uint64)
    out[order] = found
    own = (out & U(1)).astype(bool)
    out >>= U(1)
    count = out.view(np.int64)
    return count[: chunk.m + 1], own[: chunk.m + 1], count[chunk.m + 1 :], own[chunk.m + 1 :]


_OWN = "kind int, chunk long, bucket long, keys binary, a binary, b binary, c binary, size long, words binary, code long, n double"


def _rows(kind: int, chunk: int | None, bucket: int | None = None, keys=None, a=None, b=None, c=None, size=None, words=None, code=None, n=None) -> tuple:
    return kind, chunk, bucket, keys, a, b, c, size, words, code, n


def _state(number: int, chunk: Chunk, customers: np.ndarray, tables: np.ndarray, buckets: int):
    """Rows of kind 1: customers a pair's tables bring to each word, and tables in each word's restaurant."""
    for bucket, at, keys, a, b in _parcels(number, chunk.hashes, [customers, tables], buckets):
        yield _rows(1, at, bucket, keys, a, b)


def _sums(sums: dict):
    for code, n in sums.items():
        yield _rows(2, None, code=code, n=float(n))


# Codes of sums that are no byte grams.
ONCE, TWICE, TOKENS, KINDS, TEXTS, TABLES, SPELT = range(-1, -8, -1)


def _own(buckets: int):
    """Of a chunk: what sweeps need (kind 0), the first state, one table a pair (kind 1), and sums (kind 2)."""

    def run(chunks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for r in chunks.to_pylist():
            chunk = Chunk(r["size"], r["words"], r["ids"], texts=False)
            c, own_word, together, own = _counts(chunk, replies, buckets)
            own &= together > 0
            codes, together = chunk.codes[own], together[own]
            word, before = codes % chunk.width, codes // chunk.width
            out += _state(r["chunk"], chunk, *(np.bincount(x, minlength=chunk.width) for x in (word, before)), buckets)
            many = together > 1
            fixed = [np.bincount(x[~many], minlength=chunk.width) for x in (word, before)]
            flags = np.append(own_word & (c > 0), False)
            blob = pack(np.concatenate([*fixed, flags, np.diff(codes[many], prepend=0)]))
            out.append(_rows(0, r["chunk"], a=blob, b=pack(together[many]), size=r["size"], words=r["words"]))
            mine = own_word & (c > 0)
            sums = {ONCE: (~many).sum(), TWICE: (together == 2).sum(), TOKENS: c[mine].sum(), KINDS: mine.sum(), TEXTS: int((~np.frombuffer(r["held"], bool)).sum())}
            at = np.flatnonzero(mine)
            grams = _grams(*_some(chunk, at), np.ones(len(at)))
            out += _sums(sums | dict(zip(*(x.tolist() for x in grams), strict=True)))
        return pa.Table.from_batches([_batch(out, _OWN)])

    return run


def _some(chunk: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the words of these numbers, which ascend."""
    sizes = np.diff(chunk.offsets)
    keep = np.zeros(len(sizes), bool)
    keep[at] = True
    return chunk.data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])])


_STATE = "chunk long, bucket long, a binary, b binary, n double, once double, twice double"


def _add(table: pa.Table) -> pa.Table:
    """A state: customers (a) and tables (b) of the words of a bucket, summed over all chunks; on one row also all
    customers, and how many words have one and two."""
    table = table.sort_by("chunk")
    keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in column_of(table, "keys")]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    a, b = (np.bincount(inverse, np.concatenate([unpack(x.as_py()) for x in column_of(table, name)]).astype(np.float64)) for name in ("a", "b"))
    cuts = np.cumsum([0, *map(len, keys)])
    cols = {name: pa.array([pack(v[inverse[x:y]].astype(np.uint64)) for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary()) for name, v in (("a", a), ("b", b))}
    rest = np.zeros((3, len(keys)))
    rest[:, 0] = a.sum(), (a == 1).sum(), (a == 2).sum()
    return pa.table({"chunk": column_of(table, "chunk"), "bucket": column_of(table, "bucket"), **cols, "n": rest[0], "once": rest[1], "twice": rest[2]})


def discount(counts: np.ndarray, n: np.ndarray | None = None) -> float:
    """From how many dishes have one customer, and how many two."""
    one, two = (float((counts == k).sum() if n is None else n[counts == k].sum()) for k in (1, 2))
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.05


def _uniform(keys: np.ndarray, number: int) -> np.ndarray:
    """A number in [0, 1) for each key, a hash; another number, other ones."""
    return ((keys * (T.mix(np.array([number], np.uint64)) | U(1))) >> U(11)) / float(1 << 53)


def _binomial(n: np.ndarray, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Successes of n trials from uniform numbers, by inversion; beyond a mean of 12 rounded from the normal limit."""
    mean, out = n * p, np.zeros(len(n))
    wide = mean > 12
    at = np.flatnonzero(wide)
    if len(at):
        z = np.sqrt(-2 * np.log1p(-x[at])) * np.cos(2 * np.pi * y[at])
        out[at] = np.clip(np.rint(mean[at] + np.sqrt(mean[at] * (1 - p[at])) * z), 0, n[at])
    at = np.flatnonzero(~wide)
    n, odds, x = n[at], p[at] / (1 - p[at]), x[at]
    term = np.exp(n * np.log1p(-p[at]))
    left, k = x - term, 0
    while True:
        more = np.flatnonzero((left >= 0) & (n > k))
        if not len(more):
            return out
        at, n, odds, left, term = at[more], n[more], odds[more], left[more], term[more]
        k += 1
        out[at] = k
        term = term * odds * (n - k + 1) / k
        left = left - term


def seat(customers: np.ndarray, base: np.ndarray, d: float, keys: np.ndarray, draw: int) -> np.ndarray:
    """Tables of each dish after its customers are seated again, with the other dishes' tables fixed.

    A customer opens a table with weight base = (theta + d * all tables) * P(dish | parent), or sits down at one with
    weight seated - d * tables. For every count alike, customers come in blocks of an eighth of those seated, at least
    one; those of a block see the chance at its middle, with the tables at its beginning, and the number of tables they
    open is binomial. The same keys and draw give the same tables, on any executor.
    """
    order = np.argsort((65535 - np.minimum(customers, 65535)).astype(np.uint16), kind="stable")
    out = np.empty(len(order))
    for at in range(0, len(order), 1 << 15):  # so many that they stay in a core's cache
        own = order[at : at + (1 << 15)]
        out[own] = _seat(customers[own], base[own], d, keys[own], draw)
    return out


def _seat(sizes, base, d, keys, draw):
    """Of dishes with the most customers first; beyond 65535 in any order."""
    tables, most, k = np.minimum(sizes, 1).astype(np.float64), int(sizes.max()), 1
    fewest = -np.minimum(sizes, 65535)
    while k < most:
        n = int(np.searchsorted(fewest, -min(k, 65534), "left"))  # dishes with more than k customers
        block, number = max(1, k // 8), (draw * 1_000_003 + k) * 3
        weight = base[:n] + k - d * tables[:n]
        if block == 1:
            tables[:n] += _uniform(keys[:n], number) * weight < base[:n]
        else:
            step, p = np.clip(sizes[:n] - k, 0, block), base[:n] / (weight + (block - 1) / 2)
            tables[:n] += _binomial(step, p, _uniform(keys[:n], number), _uniform(keys[:n], number + 1))
        k += block
    return tables


class Spelling:
    """Samples of the byte restaurants: P(byte | two bytes before) as a dense table over the bytes that occur.

    Symbols: the bytes that occur in training, END of a word, any other byte, and BEGIN of a word as context only.
    """

    def __init__(self, counts: dict[int, int], s: Seating, draw: int):
        codes = np.array(sorted(counts), np.int64)
        n = np.array([counts[c] for c in codes.tolist()], np.int64)
        a, b, x = codes // (258 * 258), codes // 258 % 258, codes % 258
        seen = np.unique(np.concatenate([x, a, b]))
        seen = seen[seen < 256]
        m = self.m = len(seen)
        self.code = np.full(258, m + 1)
        self.code[seen] = np.arange(m)
        self.code[256], self.code[257] = m, m + 2
        a, b, x = self.code[a], self.code[b], self.code[x]
        width = m + 3
        two, one = a * width + b, b
        keys = T.mix(codes.view(np.uint64))
        c = [n, None, None]
        key2, at2 = np.unique(one * width + x, return_inverse=True)
        x2, u2 = key2 % width, key2 // width
        key1, at1 = np.unique(x2, return_inverse=True)
        t3 = np.ones(len(n))
        uniform = 1 / 257
        for sweep in range(s.byte_sweeps):
            # upwards: the tables of a restaurant are the customers of its parent
            c2 = np.bincount(at2, t3, len(key2))
            if not sweep:
                t2, t1 = np.ones(len(key2)), np.ones(len(key1))
            t2 = np.minimum(t2, c2)
            c1 = np.bincount(at1, t2, len(key1))
            t1 = np.minimum(t1, c1)
            d3, d2, d1 = discount(n), discount(c2), discount(c1)
            lam1, p1 = self._level(c1, t1, np.zeros(len(key1), int), 1, d1, s.theta)
            p1 = p1 + lam1[0] * uniform
            lam2, own2 = self._level(c2, t2, u2, width, d2, s.theta)
            p2 = own2 + lam2[u2] * p1[at1]
            tables = np.bincount(two, t3, width * width)
            t3 = seat(n, (s.theta + d3 * tables[two]) * p2[at2], d3, keys, 3 * (draw * 64 + sweep))
            c2 = np.bincount(at2, t3, len(key2))
            tables = np.bincount(u2, t2, width)
            t2 = seat(c2, (s.theta + d2 * tables[u2]) * p1[at1], d2, T.mix(key2.astype(np.uint64)), 3 * (draw * 64 + sweep) + 1)
            c1 = np.bincount(at1, t2, len(key1))
            t1 = seat(c1, (s.theta + d1 * t1.sum()) * uniform * np.ones(len(key1)), d1, T.mix(key1.astype(np.uint64)), 3 * (draw * 64 + sweep) + 2)
        # downwards: predictive probabilities of this sample
        symbols = m + 2
        lam1, own1 = self._level(c1, t1, np.zeros(len(key1), int), 1, d1, s.theta)
        first = np.full(symbols, lam1[0] * uniform)
        first[key1] += own1
        lam2, own2 = self._level(c2, t2, u2, width, d2, s.theta)
        second = lam2[:, None] * first[None, :]
        second[u2, x2] += own2
        lam3, own3 = self._level(n, t3, two, width * width, d3, s.theta)
        third = lam3.reshape(width, width, 1) * second[None, :, :]
        third[a, b, x] += own3
        self.log = np.log(third).astype(np.float32)

    @staticmethod
    def _level(c, t, of, size, d, theta):
        """What goes to the parent in each restaurant, and what each dish keeps."""
        total, tables = np.bincount(of, c, size), np.bincount(of, t, size)
        return (theta + d * tables) / (theta + total), np.maximum(c - d * t, 0) / (theta + total[of])

    def log_word(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Natural log probability of each word's spelling, its end included."""
        sizes = np.diff(offsets)
        if not len(sizes):
            return np.empty(0)
        at = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
        stream = np.full(len(data) + len(sizes), self.m)
        stream[at] = self.code[data]
        heads = offsets[:-1] + np.arange(len(sizes))
        one = np.concatenate([[self.m + 2], stream[:-1]])
        one[heads] = self.m + 2
        two = np.concatenate([[self.m + 2], one[:-1]])
        two[heads] = self.m + 2
        return np.add.reduceat(self.log[two, one, stream], heads, dtype=np.float64)


def _grams(data, offsets, weights):
    """Codes of (two symbols before, symbol) over all words, and the words' weights summed on each."""
    sizes = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
    stream = np.full(len(data) + len(sizes), 256)
    stream[at] = data
    heads = offsets[:-1] + np.arange(len(sizes))
    one = np.concatenate([[257], stream[:-1]])
    one[heads] = 257
    two = np.concatenate([[257], one[:-1]])
    two[heads] = 257
    there = np.flatnonzero(np.bincount(stream, minlength=258) + (np.arange(258) == 257))
    code, m = np.zeros(258, np.int64), len(there)
    code[there] = np.arange(m)
    sums = np.bincount((code[two] * m + code[one]) * m + code[stream], np.repeat(weights, sizes + 1))
    found = np.flatnonzero(sums)
    return (there[found // (m * m)] * 258 + there[found // m % m]) * 258 + there[found % m], sums[found]


@dataclass
class Level:
    """What one state has for all words: its spelling sample, all customers and tables of the word restaurant (before:
    of the state before, which the draws use), and the mass of the known words' spellings."""

    spelling: Spelling
    customers: float
    before: float
    tables: float = 0.0
    spelt: float = 0.0

    def seated(self, data, offsets, k: np.ndarray, hashes, s: Seating, d: float, draw: int) -> tuple[np.ndarray, np.ndarray]:
        """(spelling probability, tables) of words with k > 0 customers."""
        spelt = np.exp(self.spelling.log_word(data, offsets))
        return spelt, seat(k, (s.theta + d * self.before) * spelt, d, hashes, draw)

    def chance(self, k, tables, spelt, s: Seating, d: float, all_tables: float) -> np.ndarray:
        """Of words in the word restaurant."""
        return (np.maximum(k - d * tables, 0) + (s.theta + d * all_tables) * spelt) / (s.theta + self.customers)


def _placed(order: np.ndarray, state: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of a chunk's words in a state."""
    out = []
    for found in _joined(state, "ab"):
        own = np.zeros(len(order), np.int64)
        own[order] = found.astype(np.int64)
        out.append(own)
    return out[0], out[1]


def _sweep(shared, s: Seating, d_word: float, d_pair: float, draw: int, buckets: int):
    """One Gibbs sweep over a chunk's own words and pairs: the next state's rows, and sums. After the last state's words
    nothing follows, so only sums come."""

    def run(chunks: pa.Table, state: pa.Table) -> pa.Table:
        level, out = shared.value, []
        for r in chunks.to_pylist():
            chunk = Chunk(r["size"], r["words"])
            order, _ = _order(chunk.hashes, buckets)
            k, tables = _placed(order, state)
            held = unpack(r["a"]).astype(np.int64)
            fixed, flags, codes = held[: 2 * chunk.width].reshape(2, -1), held[2 * chunk.width : 3 * chunk.width] > 0, np.cumsum(held[3 * chunk.width :])
            at = np.flatnonzero(k[: chunk.m + 1])
            spelt, seated = level.seated(*_some(chunk, at), k[at], chunk.hashes[at], s, d_word, draw)
            own = flags[at]
            out += _sums({TABLES: seated[own].sum(), SPELT: spelt[own].sum()})
            if draw == s.sweeps:
                continue
            chance = np.zeros(chunk.width)
            chance[at] = level.chance(k[at], seated, spelt, s, d_word, level.before)
            before, word = codes // chunk.width, codes % chunk.width
            drawn = seat(unpack(r["b"]).astype(np.int64), (s.theta + d_pair * tables[before]) * chance[word], d_pair, chunk.keys(codes), draw)
            out += _state(r["chunk"], chunk, fixed[0] + np.bincount(word, drawn, chunk.width).astype(np.int64), fixed[1] + np.bincount(before, drawn, chunk.width).astype(np.int64), buckets)
            out += _sums(dict(zip(*(x.tolist() for x in _grams(*_some(chunk, at[own]), seated[own])), strict=True)))
        return pa.Table.from_batches([_batch(out, _OWN)])

    return run


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


#: Distinct pairs of a chunk that are scored at once.
PAIRS = 1 << 18


def _log_mean(chunk: Chunk, codes, together, customers, levels: list, s: Seating, d: float) -> np.ndarray:
    """log10 of the averaged probability of pairs, whose tables are drawn again from state to state. levels: for each
    state the tables in each word's restaurant, and the words' chances for scoring and for drawing the next state."""
    before, word = codes // chunk.width, codes % chunk.width
    many = np.flatnonzero(together > 1)
    keys = chunk.keys(codes[many])
    drawn, mean = np.minimum(together, 1).astype(np.float64), np.zeros(len(codes))
    for i, (tables, seen, drawing) in enumerate(levels):
        if i >= s.burn:
            mean += (np.maximum(together - d * drawn, 0) + (s.theta + d * tables[before]) * seen[word]) / (s.theta + customers[before])
        if i < s.sweeps:
            drawn[many] = seat(together[many], (s.theta + d * tables[before[many]]) * drawing[word[many]], d, keys, i)
    return np.log10(mean / (len(levels) - s.burn))


def _score(shared, s: Seating, d_word: float, d_pair: float, n: int, v: int, texts: int, buckets: int):
    """log10 of each text's probability: the states' predictive probabilities, averaged word by word."""

    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        state = column_of(found, "state").to_numpy()
        for r in chunks.to_pylist():
            chunk = Chunk(r["size"], r["words"], r["ids"])
            c, _, together, _ = _counts(chunk, found.filter(pa.array(state < 0)), buckets)
            customers = np.append(c, texts)
            customers[chunk.m] = 0  # nothing follows the end of a text
            at = np.flatnonzero(c)
            some, (order, _) = _some(chunk, at), _order(chunk.hashes, buckets)
            levels = []
            for i, level in enumerate(shared.value):
                k, tables = _placed(order, found.filter(pa.array(state == i)))
                spelt, seated = level.seated(*some, k[at], chunk.hashes[at], s, d_word, i)
                seen, drawing = np.full(chunk.width, (s.theta + d_word * level.tables) / (s.theta + level.customers) * max(1 - level.spelt, 1e-9)), np.zeros(chunk.width)
                seen[at] = level.chance(k[at], seated, spelt, s, d_word, level.tables)
                drawing[at] = level.chance(k[at], seated, spelt, s, d_word, level.before)
                levels.append((tables, seen, drawing))
            score = np.empty(len(chunk.codes))
            for low in range(0, len(score), PAIRS):
                part = slice(low, low + PAIRS)
                score[part] = _log_mean(chunk, chunk.codes[part], together[part], customers, levels, s, d_pair)
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            per = [np.add.reduceat(x, chunk.heads) for x in ((c > 0)[chunk.stream].astype(np.int64), base[chunk.stream], score[chunk.inverse])]
            sizes = np.diff(np.append(chunk.heads, len(chunk.stream)))
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(r["docs"], pa.int64()), pa.array(np.frombuffer(r["held"], bool)), pa.array(sizes), pa.array(per[0]), pa.array(np.full(len(sizes), n, np.int64)), pa.array(per[1]), pa.array(per[2])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_batch([], _SCORE)])

    return run


def score_texts(docs: DataFrame, s: Seating = Seating()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, text).

    1. A scan cuts the texts into chunks of bounded size and numbers each chunk's distinct words.
    2. Each chunk sends the hashes (64 bits) of its words and of its pairs of a word and the one before, with their
       training counts, to buckets, packed; the number of buckets follows the bytes of text. A bucket sums each key over
       the chunks and answers each chunk in its order. A key comes from a chunk once, so none is hot. The first chunk
       that has a key owns it.
    3. Gibbs sweeps: a chunk seats its own words and pairs. What a pair's tables bring to its word, and to the restaurant
       of the word before, goes through buckets like the counts and makes the next state. The spelling restaurants'
       customers, at most 258 * 258 * 257 sums, go to the driver, which seats them and broadcasts the sample.
    4. Each chunk draws the states' tables of all its words and pairs again, which gives the owner's, and scores its texts.

    Words are lower-cased (A-Z) stretches without white space; a null, blank or empty text is its end token alone. A
    null doc_id is in training. base_score: unigrams with half a count added to each word and one unknown. score: log10
    of the averaged predictive probabilities of the same events: the words seen in training, and an unknown word, whose
    probability is a new table's times the base's mass outside the words seen.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = only(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // s.bucket_bytes))
    chunks = stage(docs.mapInArrow(_index(s), _CHUNK), "chunks")
    small_batches(spark, 1)  # a row is a chunk
    replies = chunks.mapInArrow(_offers(buckets), _OFFER).groupBy("bucket").applyInArrow(_merge, "chunk long, bucket long, a binary")
    replies = stage(replies, "counts")
    release(spark)
    by = lambda frame: frame.groupBy("chunk")
    first = _by_kind(by(chunks.select("chunk", "held", "size", "words", "ids")).cogroup(by(replies)).applyInArrow(_own(buckets), _OWN))
    own = first.where("kind = 0").select("chunk", "a", "b", "size", "words")
    levels, states, rows = [], [], first
    while True:
        release(spark)
        sums = {r["code"]: r["n"] for r in rows.where("kind = 2").groupBy("code").agg(F.sum("n").alias("n")).collect()}
        if len(levels) > s.sweeps:
            levels[-1].tables, levels[-1].spelt = sums.pop(TABLES, 0.0), sums.pop(SPELT, 0.0)
            break
        state = rows.where("kind = 1").select("bucket", "chunk", "keys", "a", "b").groupBy("bucket").applyInArrow(_add, _STATE)
        states.append(stage(state, "state"))
        seen = states[-1].agg(*(F.sum(c).alias(c) for c in ("n", "once", "twice"))).first()
        if not levels:
            known = {c: int(sums.pop(c, 0)) for c in (ONCE, TWICE, TOKENS, KINDS, TEXTS)}
            pair, word = (discount(np.array([1, 2]), np.array([x or 0, y or 0])) for x, y in ((known[ONCE], known[TWICE]), (seen["once"], seen["twice"])))
        else:
            levels[-1].tables, levels[-1].spelt = sums.pop(TABLES, 0.0), sums.pop(SPELT, 0.0)
        spelling = Spelling({c: int(x) for c, x in sums.items()}, s, s.seed + len(levels))
        levels.append(Level(spelling, seen["n"] or 0.0, levels[-1].tables if levels else known[KINDS]))
        shared = spark.sparkContext.broadcast(levels[-1])
        rows = _by_kind(by(own).cogroup(by(states[-1].select("chunk", "bucket", "a", "b"))).applyInArrow(_sweep(shared, s, word, pair, len(levels) - 1, buckets), _OWN))
    release(spark)
    shared = spark.sparkContext.broadcast(levels)
    found = replies.select("chunk", F.lit(-1).alias("state"), "bucket", "a", F.lit(None).cast("binary").alias("b"))
    for i, state in enumerate(states):
        found = found.unionByName(state.select("chunk", F.lit(i).alias("state"), "bucket", "a", "b"))
    out = by(chunks).cogroup(by(found)).applyInArrow(_score(shared, s, word, pair, known[TOKENS], known[KINDS], known[TEXTS], buckets), _SCORE)
    out = stage(out, "scores")
    small_batches(spark)
    return out


def _by_kind(rows: DataFrame) -> DataFrame:
    """Staged, the kinds in files of their own."""
    spark = rows.sparkSession
    path = new_path(spark, "rows")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "3")  # a file for each kind, instead of a sort by it
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters")
    return spark.read.schema(_OWN).parquet(path)


def perplexity(scores: DataFrame) -> DataFrame:
    """Per fold: tokens, and the model's and the base's perplexity."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op5_language_model(spark, sf_dir):
    return score_texts(read(spark, sf_dir, "documents"))
