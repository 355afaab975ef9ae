"""Benchmark decontamination: a broadcast hash set of test windows, scanned against every text's windows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import column, only, read, slices, small_batches, stage, text_buffers


@dataclass(frozen=True)
class Windows:
    """n words a window. A broadcast set is made of at most block_bytes of items' text; more items go in further blocks."""

    n: int = 10
    block_bytes: int = 32 << 20


class _Set:
    """The windows of a block of items: sorted hashes by length, a bit table in front, and the items' words to verify by.

    About five bytes for each byte of items; the words of a window stay in the items' text and are compared there.
    """

    BITS = 22

    def __init__(self, items: list[tuple[int | None, str]], n: int):
        self.items = [item for item, _ in items]
        data, offsets = text_buffers(pa.array([text for _, text in items], pa.string()))
        self.data = T.LOWER[data]
        starts, ends, first = T.words(self.data, offsets, T.NOT_ALNUM)
        self.starts, self.ends, self.first = (x.astype(np.int32) for x in (starts, ends, first))
        hashes, counts = T.hash_words(self.data, starts, ends), np.diff(first)
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.bits = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            found = T.chain(hashes, size)
            at = np.flatnonzero(T.inside(first, size)) if size == n else first[:-1][counts == size]
            at = at[counts[np.searchsorted(first, at, "right") - 1] >= n] if size == n else at
            order = at[np.argsort(found[at], kind="stable")]
            self.sizes[size] = found[order], order.astype(np.int32)
            self.bits[size] = np.zeros(1 << self.BITS, bool)
            self.bits[size][(found[order] >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
        self.seen: dict[bytes, frozenset] = {}

    def _listed(self, words: bytes, size: int, low: int, high: int) -> frozenset:
        """The items with the window of these words, among the windows of one hash."""
        found = set()
        for i in self.sizes[size][1][low:high].tolist():
            if b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i : i + size], self.ends[i : i + size], strict=True)) == words:
                found.add(self.items[int(np.searchsorted(self.first, i, "right")) - 1])
        return frozenset(found)

    def hits(self, data, starts, ends, first):
        """(first word, words, items) of the verified windows, first words counted over all texts."""
        hashes = T.hash_words(data, starts, ends)
        for size, (known, _) in self.sizes.items():
            found = T.chain(hashes, size)
            at = np.flatnonzero(self.bits[size][(found >> np.uint64(64 - self.BITS)).astype(np.int64)])
            at = at[T.inside(first, size)[at]]
            low, high = np.searchsorted(known, found[at], "left"), np.searchsorted(known, found[at], "right")
            there = high > low
            for i, x, y in zip(at[there].tolist(), low[there].tolist(), high[there].tolist(), strict=True):
                words = b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + size], ends[i : i + size], strict=True))
                if words not in self.seen:
                    self.seen[words] = self._listed(words, size, x, y)
                if items := self.seen[words]:
                    yield i, size, items


_ROW = "doc_id long, n_words long, n_hit long, items array<long>, hit boolean, spans binary, mark long"


def _scan(shared):
    """Per text: its hit words, the items, and the hit stretches (first word, words) for a later union."""

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                data = T.LOWER[data]
                starts, ends, first = T.words(data, offsets, T.NOT_ALNUM)
                cover = np.zeros(len(starts) + 1, np.int64)
                items = [set() for _ in range(len(first) - 1)]
                for i, size, found in shared.value.hits(data, starts, ends, first):
                    cover[i] += 1
                    cover[i + size] -= 1
                    items[np.searchsorted(first, i, "right") - 1].update(found)
                hit = np.cumsum(cover[:-1]) > 0
                spans = []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).view(np.int8)))
                    spans.append(edge.tobytes() if len(edge) else None)
                n_hit = np.concatenate([[0], np.cumsum(hit)])[first]
                listed = [sorted(x for x in s if x is not None) for s in items]
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id")[rows], pa.array(np.diff(first)), pa.array(np.diff(n_hit)), pa.array(listed, pa.list_(pa.int64())), pa.array(np.diff(n_hit) > 0), pa.array(spans, pa.binary()), column(batch, "mark")[rows]],
                    names=["doc_id", "n_words", "n_hit", "items", "hit", "spans", "mark"],
                )

    return run


def _union(batches):
    """Stretches of several blocks: how many words they cover together."""
    for batch in batches:
        n = []
        for parts in column(batch, "parts").to_pylist():
            edges = [e for p in parts for e in np.frombuffer(p, np.int64).reshape(-1, 2).tolist()]
            last = total = 0
            for a, b in sorted(edges):
                total += max(0, b - max(a, last))
                last = max(last, b)
            n.append(total)
        yield batch.drop_columns(["parts"]).append_column("n_hit", pa.array(n, pa.int64()))


def scan(docs: DataFrame, benchmark: DataFrame, w: Windows = Windows()) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, items) of documents; mark tells unlike texts of one doc_id apart.

    An item of fewer than n words, but not none, is one window. A document word inside any occurrence of a window is
    hit. items: the item_ids with occurring windows, ascending. Null or blank texts and items have no words; an item
    without item_id hits but isn't listed. Rows with one doc_id are judged each by itself; extra columns don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = only(docs, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    items = only(benchmark, "item_id", "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // w.block_bytes))
    frames = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(_Set([(r["item_id"], r["text"]) for r in own.collect()], w.n))
        frames.append(docs.mapInArrow(_scan(shared), _ROW))
    if blocks == 1:
        return frames[0].select("doc_id", "mark", "n_words", "n_hit", "items")
    every = frames[0].select("doc_id", "mark", "n_words")
    found = stage(frames[0].where("hit"), "hits")
    for frame in frames[1:]:
        found = found.unionByName(stage(frame.where("hit"), "hits"))
    found = found.dropDuplicates(["doc_id", "mark", "items", "spans"]).groupBy("doc_id", "mark").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.collect_list("spans").alias("parts"))
    found = found.mapInArrow(_union, "doc_id long, mark long, items array<long>, n_hit long").toDF("d", "m", "items", "n_hit")
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return out.select("doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, w: Windows = Windows(), remove: str = "documents") -> DataFrame:
    """The documents, with all their columns, without what the benchmark holds.

    remove="documents": documents with a hit go. remove="spans": their hit words go, each with what stands up to the
    next word; the other bytes stay as they are. Where items fill several blocks, a document is scanned by each in turn,
    and cut once, by the union of what they hit. Null, empty and blank texts have no words and stay; repeated rows are
    judged each by itself; an item without item_id counts like any other, a null item not at all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    items = only(benchmark, "item_id", "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // w.block_bytes))
    schema, marks = docs.schema, "_hits"
    while marks.lower() in (c.lower() for c in docs.columns):
        marks += "_"
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(_Set([(r["item_id"], r["text"]) for r in own.collect()], w.n))
        last = block == blocks - 1
        if not last and remove == "spans":
            docs = docs if marks in docs.columns else docs.withColumn(marks, F.lit(None).cast("binary"))
        docs = docs.mapInArrow(_cut(shared, remove, marks, last), schema if last or remove == "documents" else docs.schema)
        if not last:  # so that a task holds one block's set at a time
            docs = stage(docs, "scanned")
    return docs


def _cut(shared, remove: str, marks: str, last: bool):
    """Takes out what a block hits. marks: a column of the word stretches that the blocks before have hit; the last block
    cuts by all of them."""

    def run(batches):
        for batch in batches:
            at_marks = batch.schema.get_field_index(marks)
            for rows, data, offsets in slices(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                low = T.LOWER[data]
                starts, ends, first = T.words(low, offsets, T.NOT_ALNUM)
                cover = np.zeros(len(starts) + 1, np.int64)
                for i, size, _ in shared.value.hits(low, starts, ends, first):
                    cover[i] += 1
                    cover[i + size] -= 1
                for d, value in enumerate(part.column(at_marks).to_pylist() if at_marks >= 0 else ()):
                    edges = np.frombuffer(value or b"", np.int64).reshape(-1, 2) + first[d]
                    np.add.at(cover, edges[:, 0], 1)
                    np.add.at(cover, edges[:, 1], -1)
                hit = np.cumsum(cover[:-1]) > 0
                bad = np.diff(np.concatenate([[0], np.cumsum(hit)])[first]) > 0
                if remove == "documents":
                    yield part.filter(pa.array(~bad))
                    continue
                if not last:
                    values = [np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).view(np.int8))).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                    yield part.set_column(at_marks, part.schema.field(at_marks), pa.array(values, pa.binary()))
                    continue
                texts = column(part, "text").to_pylist()
                for d in np.flatnonzero(bad).tolist():
                    keep = np.ones(offsets[d + 1] - offsets[d], bool)
                    for i in np.flatnonzero(hit[first[d] : first[d + 1]]) + first[d]:
                        stop = starts[i + 1] if i + 1 < first[d + 1] else ends[i]
                        keep[starts[i] - offsets[d] : stop - offsets[d]] = False
                    texts[d] = data[offsets[d] : offsets[d + 1]][keep].tobytes().decode()
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part.drop_columns([marks]) if at_marks >= 0 else part

    return run


def op6_decontamination(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), sized as (select item_id, ws, least(10, len(ws)) as n from b where len(ws) > 0
), tests as (
    select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as win from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from sized)
), lens as (select distinct n from tests
), spots as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, lens where len(ws) >= n
), hits as (
    select doc_id, i, s.n, item_id from spots s join tests t on t.n = s.n and t.win = array_to_string(ws[i:i + s.n - 1], ' ')
), covered as (
    select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(i, i + n)) as w from hits) group by 1
), listed as (
    select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from (select distinct doc_id, item_id from hits) group by 1
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join listed using (doc_id)
"""
