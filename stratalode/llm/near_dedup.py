"""MinHash near-duplicate groups with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import column, of_class, only, read, release, rows_from, rows_of, slices, small_batches, stage
from .components import components

_A = np.random.RandomState(71).randint(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Near:
    """k words a shingle; documents link where 100 * intersection >= percent * union.

    bands x rows hashes of 16 bits make a signature. A pair at the limit shares no band with probability
    (1 - (percent / 100) ** rows) ** bands: 3.8e-7 with 36 bands of 7 at 85, 5.2e-6 with 40 of 6 at 80. Verification reads batch hashes at a time and
    drops a pair once the posterior probability (uniform prior) that its similarity reaches the limit is below miss.
    """

    k: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    batch: int = 24
    miss: float = 1e-6
    star_bands: int = 2
    block_rows: int = 2048


def shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """Yields the sorted distinct shingle hashes of each text of lower-cased bytes."""
    starts, ends, first = T.words(data, offsets)
    hashes = T.hash_words(data, starts, ends)
    chains = T.chain(hashes, k)
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= k:
            yield np.unique(chains[low : high - k + 1])
        elif high > low:
            yield T.chain(hashes[low:high], int(high - low))
        else:
            yield np.empty(0, np.uint64)


def signature(found: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, ~np.uint64(0))
    for at in range(0, len(found), 1024):
        np.minimum(out, (found[None, at : at + 1024] * _A[:size, None]).min(axis=1), out=out)
    return (out >> np.uint64(48)).astype(np.uint16)


def _sketch(near: Near):
    size = near.bands * near.rows

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                n, sets, marks = [], [], []
                for found in shingles(T.LOWER[data], offsets, near.k):
                    n.append(len(found))
                    if len(found):
                        marks.append(np.array([T.mix(found * _A[-1]).sum(), T.mix(found ^ _A[-2]).sum()]).tobytes())
                        sets.append(signature(found, size).tobytes())
                    else:
                        marks.append(None)
                        sets.append(None)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[rows], pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "n_shingles", "mark", "sig"])

    return run


def _bands(near: Near):
    def run(batches):
        for batch in batches:
            sigs = rows_from(column(batch, "sig"), np.uint16, near.bands * near.rows).astype(np.uint64)
            ids = column(batch, "rep").to_numpy()
            keys = np.stack([T.mix(T.chain_columns(sigs[:, j * near.rows : (j + 1) * near.rows]) + np.uint64(j)) for j in range(near.bands)], 1)
            band = np.tile(np.arange(near.bands, dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, near.bands)), pa.array(band)], names=["key", "rep", "band"])

    return run


def least_matches(near: Near) -> list[tuple[int, int]]:
    """(hashes read, fewest matches that keep a pair) after each batch.

    With a uniform prior, m matches of n give a Beta(m + 1, n - m + 1) posterior; its mass above the limit t is the
    probability of at most m successes in n + 1 trials of probability t.
    """
    t, out, size = near.percent / 100, [], near.bands * near.rows
    for n in range(near.batch, size + 1, near.batch):
        mass, m = 0.0, 0
        while True:
            mass += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
            if mass >= near.miss:
                break
            m += 1
        out.append((n, m))
    return out


def _prune(near: Near):
    size, steps = near.bands * near.rows, least_matches(near)

    def run(batches):
        for batch in batches:
            a, b = (rows_from(column(batch, c), np.uint16, size) for c in ("sig_a", "sig_b"))
            alive, matches, done = np.arange(len(a)), np.zeros(len(a), int), 0
            for n, least in steps:
                matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
                alive, done = alive[matches[alive] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def _sets(near: Near):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                found = [x.tobytes() for x in shingles(T.LOWER[data], offsets, near.k)]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[rows], pa.array(found, pa.binary())], names=["id", "found"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, near: Near) -> bool:
    """Whether two sorted distinct sets link."""
    if 100 * min(len(x), len(y)) < near.percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= near.percent * (len(x) + len(y) - both)


def _exact(near: Near):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "set_a"), column(batch, "set_b"), strict=True):
                keep.append(_similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), near))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, reps: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) that link; signatures first, then full sets of what is left."""
    a = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    left = pairs.join(a, "a").join(b, "b").mapInArrow(_prune(near), "a long, b long").distinct()
    a = sets.select(F.col("id").alias("a"), F.col("found").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("found").alias("set_b"))
    return left.join(a, "a").join(b, "b").mapInArrow(_exact(near), "a long, b long")


def _unlinked(group: dict, near: Near, steps: list):
    """Index pairs (a, b, matches) of different components in a group that signatures don't rule out, each in the first
    band that the two share only. The largest component comes last, so its rows are never paired with one another."""
    component, block, sig = group["component"], group["block"], group["sig"]
    heads = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]]))
    apart = (block != block[0]).any()
    for low, high in zip(heads, heads[1:], strict=False):
        step = max(1, (1 << 21) // (near.batch * (len(sig) - high)))
        for at in range(low, high, step):
            own = sig[at : min(high, at + step)]
            a, b = np.nonzero((own[:, None, : near.batch] == sig[None, high:, : near.batch]).sum(2, dtype=np.uint8) >= steps[0][1])
            a, b = a + at, b + high
            if apart:
                a, b = a[block[a] != block[b]], b[block[a] != block[b]]
            matches, done = (sig[a, : near.batch] == sig[b, : near.batch]).sum(1), near.batch
            for n, least in steps[1:]:
                matches = matches + (sig[a, done:n] == sig[b, done:n]).sum(1)
                keep = matches >= least
                a, b, matches, done = a[keep], b[keep], matches[keep], n
            if len(a):
                same = (sig[a] == sig[b]).reshape(len(a), near.bands, near.rows).all(2)
                first = same.argmax(1) == group["band"]
                yield a[first], b[first], matches[first]


def _groups(batches, near: Near, with_sets: bool):
    """Rows sorted by (key, low, high) as groups of arrays, ordered so that the largest component is last."""
    size = near.bands * near.rows

    def close(held):
        out = {name: np.concatenate([h[name] for h in held]) for name in held[0] if name != "sets"}
        _, code, counts = np.unique(out["component"], return_inverse=True, return_counts=True)
        order = np.lexsort((code, counts[code]))
        if with_sets:
            every = [x for h in held for x in h["sets"]]
            out["sets"] = [every[i] for i in order.tolist()]
        out = {name: v if name == "sets" else v[order] for name, v in out.items()}
        out["band"] = out["band"][0]
        return out

    held, key = [], None
    for batch in batches:
        names = ("key", "low", "high", "band", "rep", "component", "block")
        columns = {c: column(batch, c).to_numpy() for c in names}
        columns["sig"] = rows_from(column(batch, "sig"), np.uint16, size)
        keys = np.stack([columns[c] for c in ("key", "low", "high")], 1)
        sets = column(batch, "found").to_pylist() if with_sets else None
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y == x:
                continue
            if held and tuple(keys[x]) != key:
                yield close(held)
                held = []
            key = tuple(keys[x])
            held.append({c: v[x:y] for c, v in columns.items()} | ({"sets": sets[x:y]} if with_sets else {}))
    if held:
        yield close(held)


_GROUP = "key long, low long, high long, band int, rep long, component long, block long"


def _candidates(near: Near):
    """The rows of groups that are in a pair which signatures don't rule out."""
    steps = least_matches(near)

    def run(batches):
        for group in _groups(batches, near, False):
            hit = np.zeros(len(group["rep"]), bool)
            for a, b, _ in _unlinked(group, near, steps):
                hit[a] = hit[b] = True
            if hit.any():
                n = int(hit.sum())
                columns = {"band": np.full(n, group["band"], np.int32)} | {c: group[c][hit] for c in ("key", "low", "high", "rep", "component", "block")}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.split()[0]]) for f in _GROUP.split(", ")], names=[f.split()[0] for f in _GROUP.split(", ")])

    return run


def _verified(near: Near):
    """Links (a, b) of different components in a group, by full sets, the likeliest pairs first; a pair that links found
    before join already is not looked at, so the links of a group are fewer than its rows."""
    steps = least_matches(near)

    def run(batches):
        for group in _groups(batches, near, True):
            parts = list(_unlinked(group, near, steps))
            if not parts:
                continue
            a, b, matches = (np.concatenate(x) for x in zip(*parts, strict=True))
            sets = [np.frombuffer(x, np.uint64) for x in group["sets"]]
            _, top = np.unique(group["component"], return_inverse=True)
            top, own = list(range(int(top.max()) + 1)), top.tolist()

            def find(x, top=top):
                while top[x] != x:
                    top[x] = x = top[top[x]]
                return x

            out = []
            for i in np.argsort(-matches, kind="stable").tolist():
                x, y = int(a[i]), int(b[i])
                u, v = find(own[x]), find(own[y])
                if u != v and _similar(sets[x], sets[y], near):
                    top[v] = u
                    out.append(sorted((int(group["rep"][x]), int(group["rep"][y]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return run


def _across(here: DataFrame, reps: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) that join different components of a bucket, from (key, band, rep, component).

    The rows of a bucket's largest component, and the others, fall into blocks of about block_rows. Blocks of others meet
    one another and every block of the largest component, whose rows never meet: where the others fill one block, each of
    its rows travels once. No task holds more than two blocks of a bucket. Signatures go first; full sets travel only for
    rows that some pair is left of.
    """
    sizes = here.groupBy("key", "component").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size")).where(F.col("top.n") < F.col("size"))
    blocks = lambda n: F.ceil(n / near.block_rows)
    tops = tops.select("key", F.col("top.component").alias("largest"), blocks(F.col("size") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("many"))
    rows = here.join(tops, "key")
    inside, at = F.col("component") == F.col("largest"), F.xxhash64("rep")
    rows = rows.withColumn("block", F.when(inside, F.col("few") + F.pmod(at, F.col("many"))).otherwise(F.pmod(at, F.col("few"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "rep", "component", "block")
    parts = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = reps.select(F.col("rep").alias("r"), "sig")

    def dealt(frame):
        return frame.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")

    left = stage(dealt(rows.join(sig, F.col("rep") == F.col("r")).drop("r")).mapInArrow(_candidates(near), _GROUP), "candidates")
    full = left.join(sig, F.col("rep") == F.col("r")).drop("r").join(sets.select(F.col("id").alias("r"), "found"), F.col("rep") == F.col("r")).drop("r")
    return dealt(full).mapInArrow(_verified(near), "a long, b long")


def near_dedup(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text).

    Equal shingle sets become one class first, so large groups of copies cost one signature row in what follows.
    In the buckets of the first star_bands every class is compared with the bucket's leader, which makes most groups one
    component. Then the buckets of all bands whose classes are still in several components are looked at: signatures of
    different components are compared, block against block, each pair in the first band it shares, and what they don't
    rule out is verified by full sets in the task, the likeliest first, until the group hangs together. So nothing is
    compared inside a component, no pair is ever a row, and no link that joins two components is lost.

    A null or blank text has no shingles: it links with nothing and stays. A null doc_id gives a null component and
    stays. Rows with one doc_id are one node: their components are merged, and all of them have the same kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = only(docs, "doc_id", "text")
    sketch = stage(docs.mapInArrow(_sketch(near), "doc_id long, n_shingles long, mark binary, sig binary"), "sketch")
    linked = sketch.where("doc_id is not null and mark is not null")
    classes = linked.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = linked.join(classes.select(F.col("mark").alias("m"), "rep"), F.expr("mark = m and doc_id = rep"), "left_semi")
    reps = stage(reps.select(F.col("doc_id").alias("rep"), "sig"), "reps")
    keys = reps.mapInArrow(_bands(near), "key long, rep long, band int")
    leaders = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last").select("key", "leader")
    members = stage(keys.join(leaders, "key"), "buckets")
    ids = members.select(F.col("rep").alias("id")).distinct()
    reps = stage(reps.join(ids, F.col("rep") == F.col("id"), "left_semi"), "reps")
    sets = stage(docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_sets(near), "id long, found binary"), "sets")
    release(spark)

    tried = stage(members.where(F.col("band") < near.star_bands).where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = stage(_verify(tried, reps, sets, near), "verified")
    labels = components(links)
    here = members.join(labels, F.col("rep") == F.col("id"), "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = here.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    links = stage(links.unionByName(_across(stage(here.join(mixed, "key"), "mixed"), reps, sets, near)), "verified")
    labels = components(links)
    classes = stage(classes.join(labels, F.col("rep") == F.col("id"), "left").select("mark", "n", F.coalesce("component", "rep").alias("component")), "classes")
    out = of_class(sketch.select("doc_id", "n_shingles", "mark"), classes, "component")
    # rows of one doc_id may be in several classes
    twice = out.where("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    if twice.limit(1).count():
        twice = stage(out.join(twice.select("d"), F.col("doc_id") == F.col("d"), "left_semi").select("doc_id", "component").distinct(), "shared")
        labels = components(links.unionByName(twice.select(F.col("component").alias("a"), F.col("doc_id").alias("b"))))
        merged = labels.select(F.col("id").alias("i"), F.col("component").alias("c"))
        out = out.join(merged, F.col("component") == F.col("i"), "left").select("doc_id", "n_shingles", F.coalesce("c", "component").alias("component"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup(read(spark, sf_dir, "documents"), Near(k=3, percent=85, bands=36, rows=7, batch=28))


ORACLE_SQL = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), sets as (
    select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as found from w
), sizes as (select doc_id, cast(len(found) as bigint) as n from sets
), flat as (select doc_id, unnest(found) as s from sets
), pairs as (
    select x.doc_id as a, y.doc_id as b, count(*) as n_both from flat x join flat y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2
), links as (
    select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * n_both >= 85 * (p.n + q.n - n_both)
), edges as (select a, b from links union select b, a from links
), reach as (select doc_id as id, doc_id as low from sizes union select e.b, r.low from reach r join edges e on e.a = r.id
), lows as (select id, min(low) as component_id from reach group by id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join lows on id = doc_id
"""
