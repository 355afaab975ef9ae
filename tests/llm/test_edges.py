"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import decontamination, language_model, media, near_dedup, packing, pii, substring_dedup, token_files, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, component long, mark int, dup string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog while a cat sleeps on the warm roof of an old house"),
    (2, "the quick brown fox jumps over the lazy dog while a cat sleeps on the warm roof of an old house"),
    (2, "the quick brown fox jumps over the lazy dog while a cat sleeps on the warm roof of an old house"),
    (3, None),
    (4, ""),
    (5, "  \n\t "),
    (None, "a row without an identifier mail me at a.b@example.com or +1 (555) 123-4567"),
    (None, None),
    (7, "one"),
    (8, "one two"),
    (9, LONG),
    (10, LONG + " tail"),
    (-5, "mail x.y@mail.example.org from 10.20.30.40 with card 4111111111111111 ü ß   \x00 <|endoftext|>"),
    (11, "é" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, 0, "k", 1, 2, "z") for i, t in ROWS], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_near_dedup(spark, docs, empty):
    got = near_dedup.near_dedup(docs, near_dedup.Near(k=3, percent=85, bands=36, rows=7, batch=28)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert by[10]["component_id"] == 9
    assert all(by[i]["component_id"] == i and by[i]["kept"] and by[i]["n_shingles"] == 0 for i in (3, 4, 5))
    assert by[7]["n_shingles"] == by[8]["n_shingles"] == 1 and by[7]["kept"] and by[8]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert near_dedup.near_dedup(empty).count() == 0


def test_one_id_with_several_texts_joins_their_groups(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (6, b)], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_dedup(rows).collect()} == {5}


def test_substring_dedup(spark, docs, empty):
    got = substring_dedup.substring_dedup(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_removed"] == r["n_words"] == 21 and r["text"] == "" for r in by[2])
    assert by[1][0]["n_removed"] == 0 and by[9][0]["n_removed"] == 0
    assert by[10][0]["text"] == "tail" and by[10][0]["n_words"] == 60_001
    assert {r["n_words"] for r in by[None]} == {0, len(words(ROWS[6][1]))} and all(r["n_removed"] == 0 for r in by[None])
    assert by[3][0]["text"] == by[4][0]["text"] == by[5][0]["text"] == ""
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_one_id_with_unlike_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = spark.createDataFrame([(1, a), (2, a + " x"), (2, b), (3, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(rows).collect())
    assert got == [(1, 30, 0), (2, 30, 0), (2, 31, 30), (3, 30, 30)]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "jumps over the LAZY dog, while a cat sleeps on"), (2, "One."), (3, None), (4, "--"), (None, "two"), (5, "one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.scan(docs, bench).collect()}
    assert got[1]["items"] == [1] and got[1]["n_hit"] == 10 and got[7]["items"] == [2, 5] and got[8]["n_hit"] == 2
    assert got[3]["n_words"] == 0
    assert decontamination.scan(empty, bench).count() == 0
    assert decontamination.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0
    blocks = decontamination.scan(docs, bench, decontamination.Windows(block_bytes=20))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["mark"] or 0)
    assert sorted(blocks.collect(), key=key) == sorted(decontamination.scan(docs, bench).collect(), key=key)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.schema == docs.schema and kept.count() == len(ROWS) - 5
    spans = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[1] == "the quick brown fox the warm roof of an old house" and spans[8] == "" and spans[9] == LONG


def test_decontamination_in_blocks_equals_one_block(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l m n o y", 1), (2, "f g h i j k l m n o", 2), (3, None, 3), (4, "x y", 4), (4, "x y", 5)], "doc_id long, text string, _hits int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "f g h i j k l m n o"), (3, "q r s t")], "item_id long, text string")
    for remove in ("spans", "documents"):
        one, many = (sorted(map(str, decontamination.decontaminate(docs, bench, decontamination.Windows(block_bytes=n), remove).collect())) for n in (1 << 20, 12))
        assert one == many
        assert remove == "documents" or "text='x y', _hits=1" in str(one)


def test_warc(spark):
    pages = [(1, "http://a/ b\n", "same"), (3, None, "same"), (3, "u", "same"), (2, "u", None), (4, "u", ""), (None, "u", "only"), (None, "u", "same"), (5, "u", "x" * 3_000_000)]
    frame = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, digest string")
    path = warc.write_warc(frame, warc.Bundles(frame_bytes=64, bundle_bytes=400))
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(pages)
    kind = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in got)
    assert kind == sorted([("1", 4, "revisit", "3"), ("3", 4, "response", "None"), ("3", 4, "response", "None"), ("2", 0, "revisit", "4"), ("4", 0, "response", "None"), ("None", 4, "response", "None"), ("None", 4, "revisit", "3"), ("5", 3_000_000, "response", "None")])
    assert next(r["url"] for r in got if r["page_id"] == 1) == "http://a/%20b%0A"
    small = warc.read_warc(spark, warc.write_warc(frame, warc.Bundles(min_bytes=10)))
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.read_warc(spark, warc.write_warc(frame.where("false"))).count() == 0


def test_warc_seeks_one_frame(spark):
    frame = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_warc(frame, warc.Bundles(frame_bytes=1000))
    (content,) = [bytes(r["content"]) for r in warc.read_files(spark, path).collect()]
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)  # any reader takes the file
    assert stream.read().count(b"WARC/1.1\r\n") == 40
    assert len(warc.seek_table(content)) > 10
    head, block = warc.fetch(content, warc.record_id(17))
    assert head["WARC-Record-ID"] == warc.record_id(17) and block.endswith(b"page 17 " * 50)
    assert len(list(warc._located(content))) == 40
    *frames, (at, stored, _) = warc.seek_table(content)
    lines = zstandard.ZstdDecompressor().decompress(content[at + 8 : at + stored]).splitlines(True)
    for wrong in (lines[:-1], lines[1:], lines[:5] + lines[6:], [lines[1], lines[0], *lines[2:]], [lines[0].replace(b":0>", b":1>"), *lines[1:]]):
        other = warc.Bundle(warc.Bundles())
        other.frames, other.table, other.index = [content[: frames[-1][0] + frames[-1][1]]], [(n, size) for _, n, size in frames], [x.decode() for x in wrong]
        with pytest.raises(ValueError, match="the map lea"):
            list(warc._located(other.blob() + warc.SEEK_MAGIC))


def brute_ids(text, name, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.vocabulary(name)).encode(text or "", add_special_tokens=False).ids, end]


def test_packing(spark, docs, empty):
    p = packing.Packing(tokens.vocabulary("byte_bpe_50k.json"))
    got = packing.pack(docs, p).collect()
    seen, windows = {}, {}
    for r in got:
        seen.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in ROWS:
        if i is not None and i != 2:
            assert sum((x for _, x in sorted(seen[i])), []) == brute_ids(text, "byte_bpe_50k.json", 0)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed_digest(empty, p).count() == 0


def test_best_fit_equals_placing_one_by_one():
    rng = np.random.RandomState(4)
    for _ in range(30):
        window = 64
        lengths = rng.randint(1, window + 1, rng.randint(1, 120)).tolist()
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [c for c in free if c >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(window - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = packing.best_fit(counts, window)
        used, placed = {}, 0
        rows = sorted(rows.tolist(), key=lambda r: (-r[0], r[1]))
        for at, (length, rank, each, first, before) in enumerate(rows):
            nxt = rows[at + 1][1] if at + 1 < len(rows) and rows[at + 1][0] == length else counts[length]
            for q in range(nxt - rank):
                w, o = first + q // each, before + q % each * length
                assert used.get(w, 0) == o
                used[w] = o + length
                placed += 1
        assert placed == len(lengths) and sorted(window - u for u in used.values()) == sorted(free)


def test_token_files(spark, docs, empty):
    s = token_files.Shards(tokens.vocabulary("word_bpe_49k.json"), shard_bytes=5000)
    path = token_files.write_ids(docs, s)
    got = token_files.read_digests(spark, path).orderBy("start").collect()
    assert len(got) == len(ROWS) and [r["doc_id"] for r in got] == [None, None, -5, 1, 2, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    for i, text in ROWS:
        if i is not None:
            ids = np.array(brute_ids(text, "word_bpe_49k.json", 2), "<u4")
            r = next(x for x in got if x["doc_id"] == i)
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    found = token_files.lookup(spark, path, [9, 2, 999, 3]).collect()
    assert sorted(r["doc_id"] for r in found) == [2, 2, 3, 9]
    assert next(r["ids"] for r in found if r["doc_id"] == 9) == brute_ids(LONG, "word_bpe_49k.json", 2)
    assert token_files.read_digests(spark, token_files.write_ids(empty, s)).count() == 0


def test_perfect_hash():
    for n in (1, 2, 3, 50, 3000):
        keys = np.unique(np.random.RandomState(n).randint(-(2**62), 2**62, 2 * n))[:n]
        index, slots = token_files.PerfectHash.build(keys)
        assert sorted(slots.tolist()) == list(range(n)) and (index.find(keys) == slots).all()
        others = np.random.RandomState(1).randint(0, 2**40, 2000)
        assert (index.find(np.setdiff1d(others, keys)) >= 0).mean() < 0.01


def test_media(spark, docs, empty):
    stored = media.store_media(docs)
    got = media.fingerprints(stored).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    for i, text in ROWS:
        if i is None:
            continue
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(r["pair_codes"]) == len(r["pair_frames"])
    assert media.fingerprints(media.store_media(empty)).count() == 0


def test_peak_pairs_find_a_tone():
    s = media.Sound()
    t = np.arange(8000)
    wave = (128 + 60 * np.sin(2 * np.pi * 1000 * t / s.rate) * (1 + np.sin(2 * np.pi * 8 * t / s.rate)) / 2).astype(np.uint8).tobytes()
    codes, frames = media.fingerprint(wave, s, np.hanning(s.frame).astype(np.float32))
    assert len(codes) and (np.diff(frames) >= 0).all()
    assert (codes >> 16 == 1000 * s.frame // s.rate).sum() > 3  # the tone's bin, once a swell
    assert media.from_wav(media.to_wav(wave, s)) == wave


def test_language_model(spark, docs, empty):
    got = language_model.score_texts(docs).collect()
    assert len(got) == len(ROWS)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    n = sum(len(words((t or "").lower())) + 1 for i, t in ROWS if not held(i))
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert r["score"] < 0 and r["base_score"] < 0
    assert language_model.score_texts(empty).count() == 0


def test_seating():
    rng = np.random.RandomState(0)
    c = rng.randint(0, 3000, 500)
    t = language_model.seat(c, rng.rand(500) * 5, 0.5, rng.randint(0, 2**60, 500).astype(np.uint64), 3)
    assert (t <= c).all() and (t[c > 0] >= 1).all() and (t[c == 0] == 0).all()


def test_spelling_probabilities_sum_to_one():
    text = b"abcabdaab"
    counts = {}
    previous = [257, 257]
    for x in [*text, 256]:
        code = (previous[0] * 258 + previous[1]) * 258 + x
        counts[code] = counts.get(code, 0) + 1
        previous = [previous[1], x]
    model = language_model.Spelling(counts, language_model.Seating(), 1)
    total = np.exp(model.log).sum(2) + np.exp(model.log[:, :, model.m + 1]) * (257 - model.m - 2)
    assert np.allclose(total, 1, atol=1e-5)


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    nothing = toxicity.fit(docs, labels.where("false"))
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, labels).bias < 0
    assert toxicity.drop_toxic(docs, nothing).schema == docs.schema


def test_pii(spark, docs, empty):
    model = pii.fit(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    assert len(pii.find(docs, model).collect()) == len(ROWS)
    assert got[-5]["n_email"] == got[-5]["n_ip"] == got[-5]["n_card"] == 1 and got[3]["spans"] == ""
    text = next(t for i, t in ROWS if i == -5)
    assert [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[-5]["base"].split(","))] == ["x.y@mail.example.org", "10.20.30.40", "4111111111111111"]
    clean = {r["doc_id"]: r for r in pii.redact(docs, model).collect()}
    assert "<email>" in clean[-5]["text"] and "@" not in clean[-5]["text"] and clean[-5]["n_chars"] == len(clean[-5]["text"])
    assert clean[9]["text"] == LONG and clean[3]["text"] is None
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_personal_data_in_very_long_words():
    import time

    began = time.process_time()
    word = "a" * 1_000_000
    assert pii.base_spans(word + " 1@") == [] and pii.candidates("1 " + word + "@") == []
    assert pii.candidates(word + "@b.cd 1")[0] == (0, 0, len(word) + 5)
    for text in ("1" * 1_000_000, "1." * 500_000, "a-" * 500_000 + "@", "a@" * 300_000, "+1" * 500_000, "=" * 1_000_000, "f:" * 500_000, "(at)" * 200_000, "a/" * 500_000 + "1"):
        pii.base_spans(text), pii.candidates(text)
    assert time.process_time() - began < 60


def test_personal_data_beyond_the_base_patterns(spark):
    rng = np.random.RandomState(8)
    word = lambda n=6: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    digits = lambda n: "".join(map(str, rng.randint(0, 10, n)))
    key = lambda n=32: "".join(rng.choice(list("abcdefABCDEF0123456789"), n - 1)) + "7"
    planted = [
        lambda: f"{word()} (at) {word()} (dot) com",
        lambda: f"2001:db8:{rng.randint(1, 9999)}:1:2:3:4:{rng.randint(1, 9999)}",
        lambda: ("call ", f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"),
        lambda: (f"{rng.choice(['password', 'api_key', 'token'])}=", key()),
    ]
    decoys = [lambda: f"20{rng.randint(10, 24)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(1, 9)}", lambda: f"{rng.randint(1, 99)}:{rng.randint(10, 59)}", lambda: f"width={rng.randint(1000, 9999)}px", lambda: f"page {digits(3)}", lambda: f"name: {word(9)}"]
    rows, truth = [], {}
    for i in range(1500):
        parts, spans_, at = [], [], 0
        for _ in range(6):
            kind = rng.randint(0, 10)
            made = planted[kind]() if kind < 4 else decoys[kind - 4]()
            lead, value = made if isinstance(made, tuple) else ("", made)
            fill = f"{word()} {word()} "
            if kind < 4:
                spans_.append((at + len(fill) + len(lead), at + len(fill) + len(lead) + len(value)))
            parts.append(fill + lead + value + " ")
            at += len(parts[-1])
        rows.append((i, "".join(parts)))
        truth[i] = spans_
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found, hit, added, good = pii.find(frame, pii.fit(frame)).collect(), 0, 0, 0
    for r in found:
        got = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x and x not in r["base"].split(",")]
        added += len(got)
        good += sum(any(a < y and x < e for x, y in truth[r["doc_id"]]) for a, e in got)
        hit += sum(any(a <= x and e >= y for a, e in got) for x, y in truth[r["doc_id"]])
    assert hit / sum(map(len, truth.values())) > 0.9 and good / added > 0.9


def test_secrets_of_a_table_too_small_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "password=" + "Ab3" * 100 + " end"), (2, None)], "doc_id long, text string")
    model = pii.fit(frame)
    assert not model.nodes and [r["text"] for r in pii.redact(frame, model).orderBy("doc_id").collect()] == ["password=<secret> end", None]


def test_a_bucket_of_one_large_and_many_small_components(spark):
    """Blocks of a bucket: the largest component's rows meet the others only, whatever the size of a block."""
    rng = np.random.RandomState(3)
    words_ = [f"w{i}" for i in range(400)]
    base = rng.choice(words_, 60).tolist()
    rows = []
    for i in range(120):
        t = list(base)
        for at in rng.randint(0, 60, rng.randint(0, 9)):
            t[at] = f"x{rng.randint(10_000)}"
        rows.append((i, " ".join(t)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = [near_dedup.Near(k=3, percent=85, bands=36, rows=7, batch=28, block_rows=n, star_bands=m) for n, m in ((2048, 2), (7, 2), (7, 0), (3, 1))]
    got = [sorted(map(tuple, near_dedup.near_dedup(frame, k).collect())) for k in kinds]
    assert all(x == got[0] for x in got)
    from test_brute import linked_groups

    assert {r[0]: r[2] for r in got[0]} == linked_groups(dict(rows), 3, 85)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P
    from stratalode.llm.common import stage

    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    copy = "one two three four five six seven eight"
    rows = [(1, None), (2, ""), (3, copy), (3, copy), (4, copy), (4, "other words that stand alone in here"), (None, copy), (5, "x a b c d e f g h i j k"), (6, "to a.b@c.org please " + "so long a text " * 20_000)]
    frame = spark.createDataFrame([(*r, 7, "z", 0) for r in rows], "doc_id long, text string, _gone long, component_id string, kept int")
    for docs in (frame, frame.where("false")):
        for name, step in P.STAGES:
            before, docs = docs, stage(step(spark, docs, str(tmp_path)), name)
            assert name == "packing" or docs.schema == before.schema
            if name == "near_duplicates":
                single = docs.select("doc_id", "text").collect()
            elif name == "pii":
                masked = [r["text"] for r in docs.where("doc_id = 6").collect()]
        if docs.take(1):
            kept = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in single)
            assert kept == sorted((str(i), len(t or "")) for i, t in rows if i != 4)
            assert masked[0].startswith("to <email> please so long")
            assert sorted({str(r["doc_id"]) for r in docs.collect()}) == ["1", "2", "3", "6", "None"]
        else:
            assert single == [] and masked == []
