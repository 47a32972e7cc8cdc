"""Chunks, repeated passages and their removal."""

import random

import numpy as np

from quillspark.llm import substring_dedup as S

R = random.Random(5)
V = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(5000)]


def say(n):
    return [R.choice(V) for _ in range(n)]


def brute(rows, k=50):
    """Passages by (doc_id, text): the words in k neighbouring words that a smaller doc_id has too."""
    first, out = {}, {}
    for d, t in sorted(rows):
        w = (t or "").split()
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    for d, t in rows:
        w, runs = (t or "").split(), []
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + k
                else:
                    runs.append([i, i + k])
        if runs:
            out[d, t] = [tuple(r) for r in runs]
    return out


def found(df, **how):
    texts = {(r._id, r._key): (r.doc_id, r.text) for r in S.keyed(df).collect()}
    return {texts[r._id, r._key]: [(p.first_word, p.end_word) for p in r._passages] for r in S.repeated_passages(df, **how).collect()}


def test_passages_are_those_of_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert len(want) > 10 and found(docs) == want


def test_random_passages_are_those_of_brute_force(spark):
    r = random.Random(3)
    few = ["a", "bb", "i", "der", "x" * 30, "é"]
    parts = [[r.choice(few if r.random() < 0.5 else V) for _ in range(r.randint(3, 30))] for _ in range(25)]
    rows = [(i, " ".join(w for _ in range(r.randint(1, 9)) for w in r.choice(parts))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (9, 24, 50):
        want = brute(rows, k)
        assert len(want) > 20 and found(docs, min_words=k) == want, k


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    r = random.Random(4)
    texts = [" \n ".join(say(r.randint(0, 400))).encode() for _ in range(30)] + [b"one" * 400, None, b"  "]
    want = S.words(texts)
    monkeypatch.setattr(S, "SLICE_CHARS", 90)
    assert all((a == b).all() for a, b in zip(S.words(texts), want, strict=True))
    for t in texts:  # and what stands before a text neither
        alone = S.words([t])
        assert set(alone[2].tolist()) <= set(want[2].tolist())


def test_rolling_hash_is_the_gear_recurrence():
    data = np.frombuffer(b"some bytes that are longer than sixteen", np.uint8)
    h = 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(S.GEAR[b])) & 0xFFFFFFFF
        if i >= 15:
            window = 0
            for c in data[i - 15 : i + 1]:
                window = ((window << 1) + int(S.GEAR[c])) & 0xFFFFFFFF
            assert int(S.rolling(data)[i]) == window


def test_chunks_cover_texts_and_resist_insertion():
    t = [" ".join(say(300)), "", None, "one", " ".join(["der"] * 100)]
    c = S.Chunks([x.encode() if x is not None else None for x in t])
    size = c.end - c.start
    assert [int(size[c.doc == d].sum()) for d in range(5)] == [300, 0, 0, 1, 100] and size.max() <= S.WIDTH
    w = t[0].split()
    moved = S.Chunks([" ".join([*w[:100], "inserted", *w[100:]]).encode()])
    assert len(set(c.digest[c.doc == 0].tolist()) - set(moved.digest.tolist())) <= 5


def corpus():
    shared = [say(n) for n in (60, 80, 120)]
    rows = [(i, " ".join(say(R.randint(80, 200)))) for i in range(30)]
    for k, passage in enumerate(shared):
        for d in (40 + k, 50 + k, 60 + k):
            rows.append((d, "  ".join(say(50)) + "\n" + " ".join(passage) + "\n" + " ".join(say(70))))
    line = " ".join(say(12))
    rows += [(80 + i, line + ". " + " ".join(say(90))) for i in range(5)]
    return rows, shared


def test_passages_are_found_and_cut_but_once(spark):
    rows, shared = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, copies int, _id int")
    cut = {r._id: r._passages for r in S.repeated_passages(docs.select("doc_id", "text")).collect()}
    assert set(cut) == {50, 51, 52, 60, 61, 62}
    for d, p in cut.items():
        assert [(x.first_word, x.end_word, x.owner_doc_id) for x in p] == [(50, 50 + len(shared[d % 10]), d % 10 + 40)]
    out = S.substring_dedup(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    for d, old in rows:
        if d < 50 or d >= 80:
            assert text[d] == old
    for k, passage in enumerate(shared):
        holds = [d for d in (40 + k, 50 + k, 60 + k) if " ".join(passage) in text[d]]
        assert holds == [40 + k]
        old = dict(rows)[50 + k].split()
        assert text[50 + k].split() == old[:50] + old[50 + len(passage) :]


def test_the_threshold_is_exact(spark):
    rows, want = [], set()
    for i, n in enumerate([20, 30, 40, 45, 48, 49, 50, 51, 55] * 8):
        p = say(n)
        rows += [(2 * i, " ".join(say(39) + ["ax"] + p + ["bx"] + say(39))), (2 * i + 1, " ".join(say(24) + ["ay"] + p + ["by"] + say(29)))]
        if n >= 50:
            want.add((2 * i + 1, 25, 25 + n))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r._id, x.first_word, x.end_word) for r in S.repeated_passages(docs).collect() for x in r._passages}
    assert got == want


def test_edges(spark):
    p = " ".join(say(90))
    rows = [(1, p), (1, p), (None, p), (5, None), (6, ""), (7, p + " " + p)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars long")
    out = S.substring_dedup(docs).collect()
    assert sorted(len((r.text or "").split()) for r in out if r.doc_id == 1) == [90, 90]
    assert [r.text for r in out if r.doc_id == 5] == [None] and [r.text for r in out if r.doc_id == 6] == [""]
    assert [r.text for r in out if r.doc_id is None] == [""] and all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert S.substring_dedup(docs.where("doc_id = 99")).count() == 0


def test_rows_without_ids_and_repeats_of_a_document_itself(spark):
    p, q = " ".join(say(80)), " ".join(say(70))
    rows = [(None, p + " x"), (None, p + " y"), (None, p + " y"), (3, q + " " + q), (3, "other " + q), (None, None)]
    out = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(len((r.text or "").split()) for r in out) in ([0, 1, 1, 71, 81, 140], [0, 1, 71, 81, 81, 140])
