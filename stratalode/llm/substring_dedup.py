"""Repeated passages: windows of words counted exactly through super-k-mers."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import SLICE_BYTES, column, of_class, only, read, release, slices, small_batches, stage

#: Bits of a word's number; above them, which of a doc_id's unlike texts it is in.
DUP = 40
_TWO = (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


@dataclass(frozen=True)
class Passages:
    """A window is k consecutive words; its minimiser is the least hash of m words in it.

    A minimiser with at least 1 / share of all runs in some task is a candidate for the hot list, and is on it if the
    candidates' counts reach 1 / share of all runs: so the list has at most share entries, and every minimiser with
    2 / share of all runs is on it. Windows of hot minimisers go by the hash of the window instead: those that repeat are
    broadcast if there are at most broadcast_rows of them, else joined. A task counts about task_words windows.
    """

    k: int = 13
    m: int = 3
    share: int = 2000
    broadcast_rows: int = 1_000_000
    task_words: int = 8_000_000


def _squeeze(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words joined by one blank each, and where each begins there (one more than words)."""
    sizes = ends - starts
    begins = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=begins[1:])
    out = np.full(begins[-1], 32, np.uint8)
    filled = np.ones(len(out), bool)
    filled[begins[1:] - 1] = False
    kept = np.zeros(len(data) + 1, np.int8)
    kept[starts] += 1
    kept[ends] -= 1
    out[filled] = data[np.cumsum(kept[:-1]).astype(bool)]
    return out, begins


def _runs(data: np.ndarray, offsets: np.ndarray, p: Passages):
    """Words and super-k-mers: (words per text, starts, ends, first, window at which a run starts, windows in it, minimiser, text)."""
    k, m = p.k, p.m
    starts, ends, first = T.words(data, offsets)
    hashes = T.hash_words(data, starts, ends)
    grams = T.chain(hashes, m)
    n = max(0, len(hashes) - k + 1)
    least = grams[:n].copy()
    for j in range(1, k - m + 1):
        np.minimum(least, grams[j : j + n], out=least)
    ok = T.inside(first, k)
    windows = np.flatnonzero(ok)
    if not len(windows):
        return hashes, starts, ends, first, windows, windows, least[:0], windows
    value = least[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (value[1:] != value[:-1]) | (windows[1:] != windows[:-1] + 1)
    heads = np.flatnonzero(new)
    # a boundary between texts is a gap in windows, as k > 1; a run of repeated words is cut at k windows
    age = np.arange(len(windows)) - np.repeat(heads, np.diff(np.append(heads, len(windows))))
    heads = np.flatnonzero(age % k == 0)
    lengths = np.diff(np.append(heads, len(windows)))
    return hashes, starts, ends, first, windows[heads], lengths, value[heads], np.searchsorted(first, windows[heads], "right") - 1


def _heavy(p: Passages):
    """Per text: (doc_id, n_words, mark of its words); per task: counts of its heavy minimisers and of all runs."""

    def run(batches):
        counts: dict[int, int] = {}
        total, lost = 0, 0
        for batch in batches:
            for rows, data, offsets in slices(batch):
                hashes, _, _, first, _, _, value, _ = _runs(data, offsets, p)
                values, n = np.unique(value, return_counts=True)
                total += int(n.sum())
                for v, c in zip(values.tolist(), n.tolist(), strict=True):
                    counts[v] = counts.get(v, 0) + c
                if len(counts) > 64 * p.share:  # what a decrement loses is at most total / (32 * share)
                    by = sorted(counts.values())[-32 * p.share]
                    counts = {v: c - by for v, c in counts.items() if c > by}
                    lost += by
                marks = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
                nd = len(marks)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[rows], pa.array(np.diff(first)), pa.array(marks, pa.binary()), pa.nulls(nd, pa.int64()), pa.nulls(nd, pa.int64())], names=["doc_id", "n_words", "mark", "mini", "n"])
        heavy = [(v, c + lost) for v, c in counts.items() if (c + lost) * p.share >= total]
        keys = np.array([v for v, _ in heavy], np.uint64).view(np.int64)
        nd = len(heavy) + 1
        yield pa.RecordBatch.from_arrays([pa.nulls(nd, pa.int64()), pa.nulls(nd, pa.int64()), pa.nulls(nd, pa.binary()), pa.array([None, *keys.tolist()], pa.int64()), pa.array([total, *(c for _, c in heavy)], pa.int64())], names=["doc_id", "n_words", "mark", "mini", "n"])

    return run


def _gather(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """The stretches of a buffer in a row, and where each begins there (one more)."""
    sizes = ends - begins
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return buffer[np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], sizes)], offsets


def _super(p: Passages, hot: np.ndarray, buckets: int):
    """Runs as (bucket, blob): a blob holds a slice's runs of one bucket of minimisers, equal runs once with all their hits.

    blob: Zstandard of the number of runs and of hits, hits per run, then doc_id, first word of each hit (int64),
    then the packed runs, a line each.
    """

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for rows, data, offsets in slices(batch, limit=4 * SLICE_BYTES):
                ids, dup = (column(batch, c)[rows].to_numpy(zero_copy_only=False) for c in ("doc_id", "dup"))
                hashes, starts, ends, first, heads, lengths, value, doc = _runs(data, offsets, p)
                pick = np.flatnonzero(~np.isin(value, hot))
                if not len(pick):
                    continue
                heads, lengths, value, doc = heads[pick], lengths[pick], value[pick], doc[pick]
                whole = T.chain(hashes, p.k)
                # a run has at most k windows, so its first and its last cover all its words
                mark = T.chain_columns(np.stack([value, whole[heads], whole[heads + lengths - 1], lengths.astype(np.uint64)], 1))
                order = np.argsort(mark, kind="stable")
                new = np.ones(len(order), bool)
                new[1:] = mark[order][1:] != mark[order][:-1]
                top = np.flatnonzero(new)
                one, hits = order[top], np.diff(np.append(top, len(order)))
                docs, words = ids[doc[order]], (heads - first[doc] + (dup[doc] << DUP))[order]
                home = (T.mix(value[one]) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(home, kind="stable")
                buffer, begins = _squeeze(data, starts, ends)
                one = one[by]
                text, cuts = _gather(buffer, begins[heads[one]], begins[heads[one] + lengths[one] + p.k - 1])
                text[cuts[1:] - 1] = 10
                hits_of, tops = hits[by], top[by]
                at, _ = _gather(np.arange(len(order)), tops, tops + hits_of)
                docs, words = docs[at], words[at]
                found, begin = np.unique(home[by], return_index=True)
                ends_ = np.append(begin[1:], len(by))
                hit_cuts = np.concatenate([[0], np.cumsum(hits_of)])
                blobs = []
                for x, y in zip(begin.tolist(), ends_.tolist(), strict=True):
                    h = slice(hit_cuts[x], hit_cuts[y])
                    blobs.append(pack.compress(np.array([y - x, h.stop - h.start], np.int64).tobytes() + hits_of[x:y].tobytes() + docs[h].tobytes() + words[h].tobytes() + text[cuts[x] : cuts[y]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _hot_at(data, offsets, ids, p: Passages, hot: np.ndarray):
    """Where the windows of hot minimisers are in a slice: window, text, its doc_id, two hashes of the window."""
    hashes, _, _, first, heads, lengths, value, doc = _runs(data, offsets, p)
    pick = np.flatnonzero(np.isin(value, hot))
    at, _ = _gather(np.arange(len(hashes)), heads[pick], heads[pick] + lengths[pick])
    of = np.repeat(doc[pick], lengths[pick])
    h1, h2 = (T.chain(hashes, p.k, f)[at].view(np.int64) for f in _TWO)
    return at, first, of, ids[of], h1, h2


def _hot_lows(p: Passages, hot: np.ndarray):
    """Windows of hot minimisers, each once a slice: its hashes, the least and the largest doc_id."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, limit=4 * SLICE_BYTES):
                ids = column(batch, "doc_id")[rows].to_numpy(zero_copy_only=False)
                _, _, _, owner, h1, h2 = _hot_at(data, offsets, ids, p, hot)
                order = np.lexsort((h2, h1))
                new = np.ones(len(order), bool)
                new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                top = np.flatnonzero(new)
                low, high = (f.reduceat(owner[order], top) if len(top) else owner for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1[order][top], h2[order][top], low, high)], names=["h1", "h2", "low", "high"])

    return run


def _hot_ranges(p: Passages, hot: np.ndarray, shared):
    """(doc_id, word, n) of the windows of hot minimisers that start in a smaller document, by the table of these windows."""

    def run(batches):
        known1, known2, low = shared.value
        for batch in batches:
            for rows, data, offsets in slices(batch):
                ids, dup = (column(batch, c)[rows].to_numpy(zero_copy_only=False) for c in ("doc_id", "dup"))
                at, first, of, owner, h1, h2 = _hot_at(data, offsets, ids, p, hot)
                near = np.minimum(np.searchsorted(known1, h1), len(known1) - 1)
                hit = np.flatnonzero((known1[near] == h1) & (known2[near] == h2) & (low[near] < owner))
                if not len(hit):
                    continue
                at, of = at[hit], of[hit]
                edge = np.ones(len(hit), bool)
                edge[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
                heads = np.flatnonzero(edge)
                n = np.diff(np.append(heads, len(hit)))
                yield pa.RecordBatch.from_arrays([pa.array(owner[hit][heads]), pa.array(at[heads] - first[of[heads]] + (dup[of[heads]] << DUP)), pa.array(n)], names=["doc_id", "word", "n"])

    return run


def _hot_windows(p: Passages, hot: np.ndarray):
    """The windows of hot minimisers, one by one."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                ids, dup = (column(batch, c)[rows].to_numpy(zero_copy_only=False) for c in ("doc_id", "dup"))
                at, first, of, owner, h1, h2 = _hot_at(data, offsets, ids, p, hot)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, owner, at - first[of] + (dup[of] << DUP))], names=["h1", "h2", "doc_id", "word"])

    return run


def _count(p: Passages):
    """Blobs sorted by bucket: sorts each bucket's windows and returns (doc_id, word, n), n repeats in a row from a word on."""

    def bucket(blobs: list[bytes], unpack) -> pa.RecordBatch | None:
        hits, docs, words, texts = [], [], [], []
        for blob in blobs:
            raw = unpack.decompress(blob)
            n, h = np.frombuffer(raw, np.int64, 2).tolist()
            numbers = np.frombuffer(raw, np.int64, n + 2 * h, 16)
            hits.append(numbers[:n])
            docs.append(numbers[n : n + h])
            words.append(numbers[n + h :])
            texts.append(np.frombuffer(raw, np.uint8, offset=16 + 8 * (n + 2 * h)))
        hits, docs, words, data = map(np.concatenate, (hits, docs, words, texts))
        offsets = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        starts, ends, first = T.words(data, offsets)
        hashes = T.hash_words(data, starts, ends)
        at = np.flatnonzero(T.inside(first, p.k))
        run_of = np.searchsorted(first, at, "right") - 1
        h1, h2 = (T.chain(hashes, p.k, f)[at] for f in _TWO)
        tops = np.concatenate([[0], np.cumsum(hits)])
        low = np.minimum.reduceat(docs, tops[:-1])[run_of]
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        group = np.cumsum(new) - 1
        least = np.empty(len(order), np.int64)
        least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[group]
        # only windows whose run has a hit in a larger document are repeats there
        counts = np.diff(first) - p.k + 1
        begin = np.concatenate([[0], np.cumsum(counts)])
        high = np.maximum.reduceat(docs, tops[:-1])
        runs = np.flatnonzero(np.minimum.reduceat(least, begin[:-1]) < high)
        if not len(runs):
            return None
        hit, _ = _gather(np.arange(len(docs)), tops[runs], tops[runs + 1])
        of = np.repeat(runs, hits[runs])
        sizes = counts[of]
        w, cuts = _gather(np.arange(len(at)), begin[of], begin[of] + sizes)
        owner = np.repeat(np.arange(len(hit)), sizes)
        repeat = least[w] < docs[hit][owner]
        edge = np.ones(len(w), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (repeat[1:] != repeat[:-1])
        heads = np.flatnonzero(edge)
        n = np.diff(np.append(heads, len(w)))
        heads, n = heads[repeat[heads]], n[repeat[heads]]
        return pa.RecordBatch.from_arrays([pa.array(docs[hit][owner[heads]]), pa.array(words[hit][owner[heads]] + heads - cuts[owner[heads]]), pa.array(n)], names=["doc_id", "word", "n"])

    def run(batches):
        blobs, key, unpack = [], None, zstandard.ZstdDecompressor()
        for batch in batches:
            for b, blob in zip(column(batch, "bucket").to_pylist(), column(batch, "blob"), strict=True):
                if b != key:
                    if blobs and (out := bucket(blobs, unpack)) is not None:
                        yield out
                    blobs, key = [], b
                blobs.append(blob.as_py())
        if blobs and (out := bucket(blobs, unpack)) is not None:
            yield out

    return run


def _remove(p: Passages):
    """Texts with their repeats (packed starts and counts, or all): the words that stay."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                starts, ends, first = T.words(data, offsets)
                copies, words, ns = (column(batch, c)[rows].to_pylist() for c in ("copy", "words", "ns"))
                drop = np.zeros(len(starts) + 1, np.int64)
                for d in range(len(first) - 1):
                    a, b = first[d], first[d + 1]
                    if copies[d] and b - a >= p.k:
                        drop[a] += 1
                        drop[b] -= 1
                    elif words[d]:
                        w, n = a + np.array(words[d]), np.array(ns[d])
                        np.add.at(drop, w, 1)
                        np.add.at(drop, w + n + p.k - 1, -1)
                left = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
                kept = np.searchsorted(left, first)
                text, begins = _squeeze(data, starts[left], ends[left])
                text = text.tobytes()
                cuts = begins[kept].tolist()
                texts = [text[x : max(x, y - 1)].decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                total = np.diff(first)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[rows], pa.array(total, pa.int64()), pa.array(total - np.diff(kept), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return run


def substring_dedup(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """(doc_id, n_words, n_removed, text): documents without the words of windows that also start in a smaller doc_id.

    1. A scan finds texts with the same words (only the least doc_id of each goes on; the others are repeats as a
       whole) and the hot minimisers, a list of bounded length.
    2. Consecutive windows with one minimiser travel as one packed string to the bucket of the minimiser; equal
       strings of a slice travel once. Sorting a bucket's windows (by 128-bit hash) gives the least doc_id of each.
    3. Windows of hot minimisers go by their 128-bit hash: a minimum before the shuffle; then a second look at the
       texts with the table of those that repeat, or, where that is large, a join that splits skew.

    Null or blank text: no words, none removed, and an empty text comes back. A row without doc_id keeps all its words
    and counts for no other row. Rows with one doc_id remove nothing from each other.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = only(docs, "doc_id", "text").withColumn("dup", F.lit(0).cast("long"))
    scan = stage(docs.mapInArrow(_heavy(p), "doc_id long, n_words long, mark binary, mini long, n long"), "scan")
    total = scan.where("n is not null and mini is null").agg(F.sum("n")).first()[0] or 0
    found = scan.where("mini is not null").groupBy("mini").agg(F.sum("n").alias("n")).where(F.col("n") * p.share >= total).select("mini").collect()
    hot = np.array(sorted(r["mini"] for r in found), np.int64).view(np.uint64)

    texts = scan.where("n is null and doc_id is not null")
    several = texts.groupBy("doc_id").agg(F.min("mark").alias("x"), F.max("mark").alias("y"), F.count("mark").alias("c"), F.count("*").alias("n")).where("x <> y or c < n and c > 0").select("doc_id")
    if several.limit(1).count():  # a doc_id with unlike texts: tell them apart
        docs = docs.withColumn("dup", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")).cast("long") - 1)
    marks = texts.where(F.col("n_words") >= p.k).join(several, "doc_id", "left_anti")
    classes = marks.groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    copies = stage(of_class(marks, stage(classes, "classes"), "low").where("doc_id > low").select("doc_id").distinct(), "copies")

    words = scan.agg(F.sum("n_words")).first()[0] or 0
    buckets = 16 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4, -(-words // p.task_words))
    single = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti")
    ranges = single.mapInArrow(_super(p, hot, buckets), "bucket long, blob binary").repartition(buckets // 16, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(p), "doc_id long, word long, n long")
    if len(hot):
        lows = single.mapInArrow(_hot_lows(p, hot), "h1 long, h2 long, low long, high long").groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        lows = stage(lows.where("low < high").select("h1", "h2", "low"), "hot")
        # the table is looked up by its first hash, which must tell its windows apart
        size = lows.agg(F.count("*").alias("n"), F.count_distinct("h1").alias("keys")).first()
        if size["n"] <= p.broadcast_rows and size["keys"] == size["n"]:
            table = lows.orderBy("h1").toArrow()
            if len(table):
                shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("h1", "h2", "low")))
                ranges = ranges.unionByName(single.mapInArrow(_hot_ranges(p, hot, shared), "doc_id long, word long, n long"))
        else:
            windows = single.mapInArrow(_hot_windows(p, hot), "h1 long, h2 long, doc_id long, word long")
            ranges = ranges.unionByName(windows.join(lows, ["h1", "h2"]).where("doc_id > low").select("doc_id", "word", F.lit(1).cast("long").alias("n")))
    ranges = stage(ranges, "repeats")
    release(spark)
    mask = (1 << DUP) - 1
    of_doc = ranges.groupBy("doc_id", F.shiftright("word", DUP).alias("dup")).agg(F.collect_list(F.struct(F.col("word").bitwiseAND(mask).alias("w"), "n")).alias("hits"))
    of_doc = of_doc.unionByName(copies.select("doc_id", F.lit(0).cast("long").alias("dup"), F.lit(None).cast("array<struct<w:long,n:long>>").alias("hits")))
    of_doc = of_doc.select(F.col("doc_id").alias("d"), F.col("dup").alias("u"), F.col("hits.w").alias("words"), F.col("hits.n").alias("ns"), F.col("hits").isNull().alias("copy"))
    full = docs.join(of_doc, F.expr("doc_id = d and dup = u"), "left")
    return full.select("doc_id", "text", "words", "ns", "copy").mapInArrow(_remove(p), "doc_id long, n_words long, n_removed long, text string")


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with w as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), spots as (
    select doc_id, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13
), windows as (
    select doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) as h from spots join w using (doc_id)
), low as (select h, min(doc_id) as low from windows group by h
), gone as (
    select distinct doc_id, unnest(range(i, i + 13)) as i from windows join low using (h) where low < doc_id
), cut as (select doc_id, list(i) as gone from gone group by doc_id
), kept as (
    select doc_id, ws, coalesce(gone, []) as gone, list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(coalesce(gone, []), x[2])) as left_ from w left join cut using (doc_id)
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(gone) as bigint) as n_removed, sha256(array_to_string(list_transform(left_, lambda x: x[1]), ' ')) as kept_sha256 from kept
"""
