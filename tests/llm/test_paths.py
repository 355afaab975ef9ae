"""The ways that only large inputs take give what the short ways give."""

import numpy as np
import pytest

from stratalode.llm import components, language_model, near_dedup, substring_dedup
from stratalode.llm.common import read


def joined(edges):
    low = {}

    def top(i):
        while low.setdefault(i, i) != i:
            i = low[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        low[b] = a
    return {i: top(i) for i in low}


@pytest.mark.parametrize("shape", ["path", "random", "stars"])
def test_components_in_rounds(spark, monkeypatch, shape):
    rng = np.random.RandomState(1)
    edges = {"path": [(i, i + 1) for i in range(70)] + [(200, 201)], "random": [tuple(map(int, rng.randint(0, 120, 2))) for _ in range(90)], "stars": [(i % 5, 10 + i) for i in range(60)] + [(0, 100), (100, 4)]}[shape]
    edges = [(a, b) for a, b in edges if a != b]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = joined(edges)
    assert {r["id"]: r["component"] for r in components.components(frame).collect()} == want
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert {r["id"]: r["component"] for r in components.components(frame).collect()} == want


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The documents, and groups of near copies, exact copies and texts that share a line."""
    rng = np.random.RandomState(3)
    base = [f"w{i}" for i in rng.randint(0, 500, 80)]
    line = " ".join(f"line{i}" for i in range(30))
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.randint(0, 80, rng.randint(0, 5)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((100_000 + i, " ".join(words)))
        rows.append((200_000 + i, f"{' '.join(f'y{rng.randint(0, 10**6)}' for _ in range(20))} {line} {' '.join(f'z{rng.randint(0, 10**6)}' for _ in range(20))}"))
        rows.append((300_000 + i, "the same words over and over " * 4))
    return read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).persist()


def test_near_dedup_by_small_blocks_and_rounds(docs):
    want = sorted(near_dedup.near_dedup(docs).select("doc_id", "component_id").collect())
    assert 1 < len({c for d, c in want if 100_000 <= d < 100_060}) < 60  # some hang together, some do not
    for near in (near_dedup.Near(block_rows=3), near_dedup.Near(star_bands=0), near_dedup.Near(star_bands=40)):
        assert sorted(near_dedup.near_dedup(docs, near).select("doc_id", "component_id").collect()) == want


def test_near_dedup_by_brute_force(docs):
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    sets = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in rows.items()}
    ids = sorted(sets)
    edges = [(i, i) for i in ids]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                edges.append((a, b))
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()} == joined(edges)


@pytest.mark.parametrize("limit", [10**6, -1])
def test_hot_minimisers(docs, limit):
    want = sorted(substring_dedup.substring_dedup(docs, substring_dedup.Passages(share=1)).select("doc_id", "n_words", "n_removed", "text").collect())
    got = substring_dedup.substring_dedup(docs, substring_dedup.Passages(share=10_000_000, broadcast_rows=limit))  # every minimiser is hot
    assert sorted(got.select("doc_id", "n_words", "n_removed", "text").collect()) == want
    some = substring_dedup.substring_dedup(docs, substring_dedup.Passages(share=300, broadcast_rows=limit))
    assert sorted(some.select("doc_id", "n_words", "n_removed", "text").collect()) == want
    rows = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    low = {}
    for i in sorted(rows):
        for a in range(len(rows[i]) - 12):
            low.setdefault(tuple(rows[i][a : a + 13]), i)
    for d, n, removed, text in want:
        w, gone = rows[d], set()
        for a in range(len(w) - 12):
            if low[tuple(w[a : a + 13])] < d:
                gone.update(range(a, a + 13))
        assert (n, removed, text) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_language_model_by_small_chunks(docs):
    key = lambda r: r["doc_id"]
    one = sorted(language_model.score_texts(docs).collect(), key=key)
    many = sorted(language_model.score_texts(docs, language_model.Seating(chunk_bytes=5000)).collect(), key=key)
    for a, b in zip(one, many, strict=True):
        assert (a["doc_id"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["doc_id"], b["n_tokens"], b["n_known"], b["train_tokens"])
        assert abs(a["base_score"] - b["base_score"]) < 1e-6 and abs(a["score"] - b["score"]) < 1e-3 * abs(a["score"])
