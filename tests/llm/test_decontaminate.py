"""Window hits against brute force, in one block of windows and in several."""

import random
import re

import numpy as np
import pytest

from quillspark.llm import common as C
from quillspark.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            x = words(t)
            n = min(13, len(x))
            for s in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(i)
        out.append((d, len(w), len(hit), len(found), D.item_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def cases():
    r = random.Random(3)
    v = ["the", "of", "Straße", "déjà", "x1", "alpha", "beta", "Gamma", "delta", "eps"]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(1, say(40)), (2, say(13)), (3, "alpha, BETA gamma!"), (4, ""), (5, None), (10, say(20))]
    docs = [(i, say(r.randint(0, 60))) for i in range(20)]
    docs += [(50, "A " * 30 + items[0][1].upper()), (51, items[1][1] + " . " + items[1][1]), (52, "Alpha beta--gamma"), (53, None), (54, ""), (55, items[5][1] + " " + "zz " * 400), (50, "repeated id")]
    return docs, items


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_contamination(spark, block):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(d, b, ["doc_id"], block_windows=block).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, items)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one two x three four"), (2, "one y y y y two three four")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    got = {r.doc_id: r._n_items for r in D.contamination(d, b, ["doc_id"], slop=1).collect()}
    assert got == {1: 1, 2: 0}


def test_filter_keeps_whole_rows_and_clashing_columns(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(docs)], "doc_id long, text string, _hit int, _n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    bad = {(x[0], x[1]) for x in brute(docs, items) if x[-1]}
    out = D.decontaminate(d, b)
    assert out.columns == d.columns
    assert sorted(r._hit for r in out.collect()) == [i for i, r in enumerate(docs) if (r[0], len(words(r[1]))) not in bad]
    assert D.decontaminate(d, b.where("item_id > 99")).count() == len(docs)
    assert D.decontaminate(d.where("doc_id > 99"), b).count() == 0


def test_hashes_of_words_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(2)
    data = np.frombuffer(" ".join("".join(r.choices("abé", k=r.randint(1, 9))) for _ in range(500)).encode() + b" x" * 40 + b"y" * 300 + b"  ", np.uint8)
    want = C.hashed_words(data, data == 32)
    for piece in (1, 7, 64):
        monkeypatch.setattr(C, "PIECE", piece)
        C._powers.cache_clear()
        assert all((a == b).all() for a, b in zip(C.hashed_words(data, data == 32), want, strict=True))
    C._powers.cache_clear()
    words = bytes(data).split()
    assert len(set(want[2].tolist())) == len(set(words)) and len(words) == len(want[2])


def test_a_very_long_text(spark):
    item = " ".join(f"it{i}" for i in range(20))
    text = " ".join(f"w{i % 5000}" for i in range(600_000))
    d = spark.createDataFrame([(1, f"{text} {item} {text}"), (2, item)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r._n_words, r._n_hit, r._contaminated) for r in D.contamination(d, b, ["doc_id"]).collect()}
    assert got == {1: (1_200_020, 20, False), 2: (20, 20, True)}


def test_anchors_in_runs_give_the_same_and_stay_bounded(monkeypatch):
    import tracemalloc

    many = np.array([3, 0, 5, 1])
    whole = [(w, k) for w, n in enumerate(many) for k in range(n)]
    for most in (1, 2, 4, 100):
        monkeypatch.setattr(D, "ANCHORS", most)
        runs = list(D._anchors(many))
        assert [(int(a), int(b)) for w, k in runs for a, b in zip(w, k, strict=True)] == whole and all(len(w) <= most for w, _ in runs)
    r = np.random.default_rng(1)
    vocabulary = [f"v{i}" for i in range(50)]
    text = " ".join(r.choice(vocabulary, 60_000)).encode()
    windows = D.Windows([(1, " ".join(r.choice(vocabulary, 3000)).encode()), (2, text[:90])], 13)
    n, all_ = D.hashed([text])
    order = np.argsort(all_, kind="stable")
    terms, counts = np.unique(all_, return_counts=True)
    at, own = windows.met(terms)
    peak, found = [], []
    for most in (20_000, 10**9):
        monkeypatch.setattr(D, "ANCHORS", most)
        tracemalloc.start()
        found.append([sorted(x.tolist()) for x in D.match(windows, n, own, counts[at], order)])
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert found[0] == found[1] and found[0][0] and peak[0] * 8 < peak[1]
