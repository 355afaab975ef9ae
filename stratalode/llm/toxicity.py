"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import column, only, read, slices, small_batches

PREFIXES = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Weak:
    """Labelled rows with crc32(doc_id as text) mod folds == fold teach nothing.

    At most max_train labelled documents, those whose doc_id has the least hash, are read to learn; scoring reads all.
    Features are words and word beginnings, hashed to 2 ** bits numbers; a voter is a tier of per_voter features.
    """

    folds: int = 5
    fold: int = 0
    max_train: int = 6000
    bits: int = 31
    voters: int = 48
    per_voter: int = 2
    features: int = 800
    least: int = 4


@dataclass
class Model:
    """Numbers of the weighted features (ascending), their weights, the bias."""

    numbers: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -30.0
    bits: int = 31


def learns(doc_id: int | None, w: Weak) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % w.folds != w.fold


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """(text, number) of each word's features: the word, and its beginnings where it is longer."""
    low = T.LOWER[data]
    starts, ends, first = T.words(low, offsets, T.NOT_ALNUM)
    of = T.text_of_word(first)
    texts, numbers = [of], [T.hash_words(low, starts, ends)]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        texts.append(of[long])
        numbers.append(T.mix(T.hash_words(low, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(texts), (np.concatenate(numbers) >> np.uint64(64 - bits)).astype(np.int64)


def _patterns(text: str) -> list[bool]:
    """Pattern voters: shouting, exclamations, question storms, stretched letters."""
    n = max(len(text), 1)
    upper = sum(map(str.isupper, text))
    return [upper > 0.3 * n, text.count("!") * 100 > n, "!!" in text, "?!" in text or "??" in text]


def _examples(w: Weak):
    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                of, numbers = features(data, offsets, w.bits)
                pairs = np.unique(of << w.bits | numbers)
                cuts = np.searchsorted(pairs, np.arange(len(offsets)) << w.bits)
                own = (pairs & ((1 << w.bits) - 1)).astype(np.int32)
                found = [own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                marks = [np.array(_patterns(x or "")).tobytes() for x in column(batch, "text")[rows].to_pylist()]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[rows], column(batch, "toxic")[rows], pa.array(found, pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "toxic", "found", "marks"])

    return run


def _tree(votes: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(voter, parent or -1) in order: the spanning tree of the largest mutual information given the label."""
    m, info = votes.shape[1], np.zeros((votes.shape[1],) * 2)
    for weight in (y, 1 - y):
        total = weight.sum() + 1e-9
        both = (votes * weight[:, None]).T @ votes / total
        p = np.diag(both).copy()
        for a, b in ((1, 1), (1, 0), (0, 1), (0, 0)):
            joint = {(1, 1): both, (1, 0): p[:, None] - both, (0, 1): p[None, :] - both, (0, 0): 1 - p[:, None] - p[None, :] + both}[a, b]
            single = (p if a else 1 - p)[:, None] * (p if b else 1 - p)[None, :]
            info += total / len(y) * joint * np.log(np.maximum(joint, 1e-9) / np.maximum(single, 1e-9))
    order, left = [(0, -1)], set(range(1, m))
    while left:
        i, j = max(((i, j) for i in left for j, _ in order), key=lambda x: info[x])
        order.append((i, j))
        left.remove(i)
    return order


def label_model(votes: np.ndarray, prior: float, known: np.ndarray, fresh: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior of the positive label for rows of 0/1 votes, by EM.

    A voter that abstains says nothing by itself (which lexicon a text could meet depends on its language), only that
    all of them abstain does. First voters count as independent given the label; then each depends on one other as
    well, along the tree of the strongest correlations, so voters that say the same thing aren't counted twice. known:
    labels of a small development set, which fixes what a voter is worth; nan where the label stays hidden. fresh: rows
    that no voter was made of; the others are given a posterior, but what a voter is worth doesn't come from them.
    """
    shown = ~np.isnan(known)
    silent = votes.sum(1) == 0
    y = np.where(shown, known, np.where(silent, 0.1 * prior, 0.5))
    tree = None

    def odds(of, q):
        """Log of how much likelier rows are under the positive label."""
        of, q = of[0][of[1]], q[of[1]]
        p1, p0 = (np.sum(of * q) + 0.1) / (q.sum() + 1), (np.sum(of * (1 - q)) + 0.1) / ((1 - q).sum() + 1)
        return np.log(p1 / p0)

    for round_ in range(rounds):
        if round_ == 5:
            tree = _tree(votes[fresh], y[fresh])
        share = min(max(y.mean(), 0.2 * prior), 0.95)
        score = np.full(len(y), np.log(share / (1 - share)))
        score[silent] += min(0.0, odds((silent, fresh), y))
        for j, parent in tree or [(j, -1) for j in range(votes.shape[1])]:
            for state in (0, 1) if parent >= 0 else (None,):
                rows = np.arange(len(y)) if state is None else np.flatnonzero(votes[:, parent] == state)
                score[rows] += np.where(votes[rows, j] > 0, odds((votes[rows, j], fresh[rows]), y[rows]), 0.0)
        y = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        posterior, y = y, np.where(shown, known, y)
    return posterior


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, rounds: int = 12):
    """Weights and bias of a linear classifier on soft labels, by Newton steps with a quadratic penalty."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-4).astype(np.float32)[:, None]).T @ x
        w -= np.linalg.solve(curve + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, w: Weak = Weak()) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic).

    Half of the examples give the voters: features whose odds speak for toxic, in tiers of falling odds, and the patterns
    that are twice as frequent in toxic ones. On
    all examples the label model turns votes into posterior labels, on which the linear classifier is trained; the true
    labels of the other half set its scale and bias. Labels of the held-out fold, null labels and labels without a
    document are never read; a doc_id with several labels counts as toxic if one says so. Without examples of both
    kinds every score is the share of toxic examples (0 without any).
    """
    spark = docs.sparkSession
    small_batches(spark)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(crc % w.folds != w.fold)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(w.max_train)
    rows = only(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(_examples(w), "doc_id long, toxic long, found binary, marks binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "found").limit(w.max_train).collect()
    y = np.array([r["toxic"] for r in rows], float)
    marks = np.array([np.frombuffer(r["marks"], bool) for r in rows], float)
    return learn(y, [np.frombuffer(r["found"], np.int32) for r in rows], marks, w)


def learn(y: np.ndarray, found: list[np.ndarray], marks: np.ndarray, w: Weak) -> Model:
    """The model from examples: labels, distinct feature numbers of each, pattern votes."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(bias=float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))), bits=w.bits)
    # features of three examples or more, numbered anew; the others can't be told from chance
    sizes = np.array([len(x) for x in found])
    every = np.concatenate(found)
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    del every
    often = counts >= 3
    values, new = values[often].astype(np.int64), np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
    inverse = new[inverse]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    found = [inverse[a:b][inverse[a:b] >= 0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    del inverse
    half = np.arange(len(y)) % 2 == 0
    size = len(values)

    def odds(weight: np.ndarray, use: np.ndarray):
        """Of each feature: the log odds ratio between weighted positive and negative rows, positive and other counts."""
        pick = np.flatnonzero(use)
        at = np.concatenate([found[i] for i in pick])
        yes = np.bincount(at, np.repeat(weight[pick], [len(found[i]) for i in pick]), size)
        no = np.bincount(at, minlength=size) - yes
        n1, n0 = weight[pick].sum(), (1 - weight[pick]).sum()
        return np.log((yes + 0.2) / (n1 - yes + 0.2)) - np.log((no + 0.2) / (n0 - no + 0.2)), yes, no

    ratio, yes, no = odds(y, half)
    sure = ratio - np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))  # the odds less their standard error
    # a feature must speak more clearly than the luckiest of as many features would by chance
    share, both = y[half].mean(), np.maximum(yes + no, 1)
    surprise = yes * np.log(np.maximum(yes, 1e-9) / both / share) + no * np.log(np.maximum(no, 1e-9) / both / (1 - share))
    lexicon = np.flatnonzero((yes >= 3) & (sure > 2) & (surprise > np.log(max(size, 2))))
    # a word and its beginnings often mark the same examples: one of them is enough for a voter
    print_of = np.random.RandomState(7).rand(len(y))
    prints = np.bincount(np.concatenate(found), np.repeat(print_of, [len(x) for x in found]), size)
    lexicon = lexicon[np.sort(np.unique(prints[lexicon].round(9), return_index=True)[1])]
    lexicon = lexicon[np.argsort(-sure[lexicon], kind="stable")][: w.voters * w.per_voter]
    voter = np.full(size, -1, np.int64)
    voter[lexicon] = np.arange(len(lexicon)) // w.per_voter
    count = max(1, -(-len(lexicon) // w.per_voter))
    votes = np.zeros((len(y), count))
    for i, own in enumerate(found):
        hit = voter[own]
        votes[i, hit[hit >= 0]] = 1
    # pattern voters that the same half speaks for
    yes, both = marks[half].T @ y[half], marks[half].sum(0)
    rate = (yes + 0.5) / (both + 1) / max(y[half].mean(), 1e-9)
    votes = np.concatenate([votes, marks[:, (both >= 3) & (rate > 2)]], 1)
    posterior = label_model(votes, float(y[half].mean()), np.where(np.arange(len(y)) % 4 == 1, y, np.nan), ~half)
    ratio, yes, _ = odds(posterior, np.ones(len(y), bool))
    strong = np.flatnonzero(yes >= w.least / 2)
    strong = np.sort(strong[np.argsort(-(ratio * np.sqrt(yes))[strong], kind="stable")][: w.features])
    place = np.full(size, -1)
    place[strong] = np.arange(len(strong))
    x = np.zeros((len(y), len(strong)), np.float32)
    for i, own in enumerate(found):
        x[i, place[own][place[own] >= 0]] = 1
    numbers = values[strong]
    weights, bias = _logistic(x, posterior)
    z = x @ weights + bias
    scale, shift = 1.0, 0.0
    for _ in range(200):  # scale and bias by the true labels of the half that no lexicon came from
        p = 1 / (1 + np.exp(-np.clip(scale * z[~half] + shift, -30, 30)))
        gap, curve = p - y[~half], p * (1 - p) + 1e-3
        scale -= 0.5 * ((gap * z[~half]).mean() + 1e-4 * (scale - 1)) / (curve * z[~half] ** 2).mean()
        shift -= 0.5 * (gap.mean() + 1e-4 * shift) / curve.mean()
        scale = max(scale, 0.05)
    return Model(numbers, (scale * weights).astype(float), float(scale * bias + shift), w.bits)


def _scores(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    n = len(offsets) - 1
    z = np.full(n, model.bias)
    if len(model.numbers):
        of, numbers = features(data, offsets, model.bits)
        front = np.zeros(1 << 16, bool)
        front[model.numbers >> (model.bits - 16)] = True
        pick = np.flatnonzero(front[numbers >> (model.bits - 16)])
        at = np.minimum(np.searchsorted(model.numbers, numbers[pick]), len(model.numbers) - 1)
        hit = model.numbers[at] == numbers[pick]
        pairs = np.unique(of[pick][hit] * len(model.numbers) + at[hit])
        z += np.bincount(pairs // len(model.numbers), model.weights[pairs % len(model.numbers)], n)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability that a text is toxic, from its words alone. A null, blank or empty text gets the
    bias. Rows are independent of each other, so repeated rows have equal scores."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[rows], pa.array(_scores(data, offsets, shared.value))], names=["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is below the limit."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch):
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(_scores(data, offsets, shared.value) < limit))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
