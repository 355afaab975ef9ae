"""Whatever the base patterns leave out."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratalode.llm import language_model, media, pii, toxicity

BEYOND = [
    ("email", "jane.doe (at) example (dot) com", "write to {} soon"),
    ("email", "joe [at] mail.example.org", "or {}. Then wait"),
    ("ip", "2001:db8:85a3:1:2:8a2e:370:7334", "seen from {} today"),
    ("ip", "fe80::1ff:fe23:4567:890a", "seen from {} today"),
    ("card", "4111.1111.1111.1111", "paid with {} then"),
    ("phone", "(555) 123-4567", "call me at {} now"),
]


@pytest.mark.parametrize("kind,value,around", BEYOND)
def test_spans_beyond_the_base(kind, value, around):
    text = around.format(value)
    start = text.index(value)
    base, every = pii.spans(text, pii.Trees(), 32)
    assert base == [] and every == [(start, pii.KINDS.index(kind), start + len(value))]
    assert [pii._weak_label(text, *x, base) for x in every] == [1]


@pytest.mark.parametrize("text", ["at 12:30:45 and 10:20:30:40", "std::a::b and a::b", "from aa:bb:cc:dd:ee:ff", "4111.1111.1111.1112", "call 2024-01-15", "look (at) this", "in 5551234567 ways"])
def test_no_spans_without_evidence(text):
    assert pii.spans(text, pii.Trees(), 32) == ([], [])


def test_redaction_beyond_the_base(spark):
    docs = spark.createDataFrame([(i, around.format(value)) for i, (_, value, around) in enumerate(BEYOND)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.fit(docs)).collect()}
    assert got == {i: around.format(f"<{kind}>") for i, (kind, _, around) in enumerate(BEYOND)}


def test_language_model_sees_the_order_of_words(spark):
    lines = [f"the old {a} sat on a {b}" for a in ("cat", "dog", "fox", "hen") for b in ("mat", "rug", "box", "bed")]
    rows = [(i, x) for i, x in enumerate(lines * 4) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(10_000, 10_050) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows += [(held[0], "the old dog sat on a bed"), (held[1], "bed a on sat dog old the")]
    got = {r["doc_id"]: r for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 3


def test_scores_equal_a_plain_model(spark):
    """The model written out with dictionaries, over one corpus; Spark's has many chunks and buckets."""
    import collections
    import math
    import zlib

    L, rng = language_model, np.random.RandomState(9)
    s = L.Seating(chunk_bytes=300, bucket_bytes=200)
    names = ["a", "bb", "The", "the", "cat", "sat", "on", "mat", "é", "dog"] + [f"rare{i}" for i in range(40)]
    texts = [" ".join(rng.choice(names, rng.randint(0, 12), p=[0.08] * 10 + [0.005] * 40)) for _ in range(150)]
    got = {r["doc_id"]: r["score"] for r in L.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), s).collect()}

    words = [[x.encode().lower() for x in t.split()] + [b"\n"] for t in texts]
    train = [w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(p for w in train for p in zip([None, *w], w))
    known, pairs = sorted({x for _, x in c}), sorted(c, key=str)
    hashed = lambda x: L.BEGIN_HASH if x is None else L.T.hash_words(np.frombuffer(x, np.uint8), np.zeros(1, int), np.array([len(x)]))[0]
    keys = np.array([L.T.mix(np.array([hashed(u)]) * np.uint64(0xA0761D6478BD642F) + L.T.mix(np.array([hashed(x)])))[0] for u, x in pairs])
    data, offsets = np.frombuffer(b"".join(known), np.uint8), np.cumsum([0, *map(len, known)])
    share = lambda x: L.discount(np.array([1, 2]), np.array([sum(n == k for n in x) for k in (1, 2)]))
    d_pair, followed, tables, before, seated, samples = share(c.values()), collections.Counter(), dict.fromkeys(pairs, 1.0), len(known), np.ones(len(known)), []
    for (u, _), n in c.items():
        followed[u] += n
    for i in range(s.sweeps + 1):
        k, here = collections.Counter(), collections.Counter()
        for (u, x), n in tables.items():
            k[x] += n
            here[u] += n
        counts = np.array([k[x] for x in known])
        d = share(counts) if not i else d
        spelling = L.Spelling({int(a): int(b) for a, b in zip(*L._grams(data, offsets, seated), strict=True)}, s, s.seed + i)
        spelt = np.exp(spelling.log_word(data, offsets))
        seated = L.seat(counts.astype(int), (s.theta + d * before) * spelt, d, np.array([hashed(x) for x in known]), i)
        chance = lambda all_, counts=counts, seated=seated, spelt=spelt: dict(zip(known, (np.maximum(counts - d * seated, 0) + (s.theta + d * all_) * spelt) / (s.theta + counts.sum()), strict=True))
        new = (s.theta + d * seated.sum()) / (s.theta + counts.sum()) * (1 - spelt.sum())
        samples.append((chance(seated.sum()), new, tables, here))
        weights = chance(before)
        drawn = L.seat(np.array([c[p] for p in pairs]), np.array([(s.theta + d_pair * here[u]) * weights[x] for u, x in pairs]), d_pair, keys, i)
        before, tables = seated.sum(), dict(zip(pairs, drawn, strict=True))

    def probability(u, x):
        each = [(max(c[u, x] - d_pair * t.get((u, x), 0), 0) + (s.theta + d_pair * here[u]) * p.get(x, new)) / (s.theta + followed[u]) for p, new, t, here in samples[s.burn :]]
        return sum(each) / len(each)

    for u in [None, b"unknown", *(x for x in known if x != b"\n")]:
        assert abs(sum(probability(u, x) for x in [*known, b"unknown"]) - 1) < 1e-9
    for i, w in enumerate(words):
        assert abs(got[i] - sum(math.log10(probability(u, x)) for u, x in zip([None, *w], w))) < 1e-6
    assert any(n > 1 for n in drawn) and probability(b"cat", b"sat") != probability(b"on", b"sat")



def test_shouting_counts_over_the_whole_text():
    assert toxicity._patterns("a" * 4000 + "A" * 8000)[0] and not toxicity._patterns("A" * 4000 + "a" * 20_000)[0]


def test_the_last_samples_count_in_fingerprints():
    sound, window = media.Sound(), np.hanning(256).astype(np.float32)
    one = np.random.RandomState(2).randint(0, 256, 320).astype(np.uint8)
    other = one.copy()
    other[-64:] = 255 - other[-64:] // 2
    a, b = (media.fingerprint(x.tobytes(), sound, window) for x in (one, other))
    assert not (np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]))
