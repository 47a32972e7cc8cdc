"""The chain's marginals against enumeration; the fit on held-out documents; edges."""

import itertools
import math
import random
import zlib

import numpy as np

from quillspark.llm import toxicity as T


def slow_marginals(e, trans):
    total, one = 0.0, np.zeros(len(e))
    for states in itertools.product((0, 1), repeat=len(e)):
        w = np.exp(sum(x for x, s in zip(e, states, strict=True) if s) + sum(trans[a, b] for a, b in zip(states, states[1:], strict=False)))
        total += w
        one += w * np.array(states)
    return one / total


def test_marginals_are_exact():
    r = np.random.default_rng(0)
    trans = r.normal(size=(2, 2))
    parts = [r.normal(size=n) * 2 for n in (1, 9, 4, 7)]
    first = np.concatenate([np.arange(len(p)) == 0 for p in parts])
    got = T.chain_marginals(np.concatenate(parts), first, trans)
    assert np.allclose(got, np.concatenate([slow_marginals(p, trans) for p in parts]))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = T.score_toxicity(docs.select("doc_id", "text"), T.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    hit = [r for r in held if r.score >= T.THRESHOLD]
    assert sum(r.toxic for r in hit) >= 0.9 * len(hit) and sum(r.toxic for r in hit) >= 0.6 * sum(r.toxic for r in held)
    text = {r.doc_id: r.text for r in docs.collect()}
    found = [text[r.doc_id][s.start : s.end] for r in hit for s in r.spans]
    assert found and all(w.strip() == w for w in found)


def test_edges(spark):
    rows = [(i, "you are a stupid loser " * 3 if i % 3 == 0 else "a fine and quiet day " * 3) for i in range(90)]
    docs = spark.createDataFrame([*rows, (200, None), (201, ""), (202, "İ stupid"), (203, "..."), (None, "stupid loser")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, None), (999, 1), (None, 1)], "doc_id long, toxic int")
    tagger = T.train(docs, labels)
    extra = docs.selectExpr("doc_id", "text", "1 as score", "'x' as spans", "2 as _score")
    out = T.reject_toxic(extra, tagger)
    assert out.columns == extra.columns
    left = [r.doc_id for r in out.collect()]
    assert set(left) >= {200, 201, 203} and not [i for i in left if i is not None and i < 90 and i % 3 == 0]
    scored = {r.doc_id: r for r in T.score_toxicity(docs, tagger).collect()}
    assert scored[200].score == scored[201].score == scored[203].score < 0.7
    assert all("İ stupid"[s.start : s.end] == "stupid" for s in scored[202].spans)
    none = T.train(docs, labels.where("toxic = 0"))
    assert {r.score for r in T.score_toxicity(docs, none).collect()} == {0.0}
    assert T.score_toxicity(docs.where("doc_id = 999"), tagger).count() == 0


def slow_chain(e, trans):
    """Marginals and expected pairs of a chain by enumeration."""
    total, one, pair = 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for z in itertools.product((0, 1), repeat=len(e)):
        w = math.exp(sum(x * s for x, s in zip(e, z, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(z)))
        total += w
        one += w * np.array(z)
        for a, b in itertools.pairwise(z):
            pair[a, b] += w
    return one / total, pair / total


def test_expectations_of_the_fit_are_those_of_enumeration():
    r = np.random.default_rng(6)
    trans, n = r.normal(size=(2, 2)), [6, 1, 4]
    e, on = np.zeros((3, 6)), np.zeros((3, 6), bool)
    for i, k in enumerate(n):
        e[i, :k], on[i, :k] = r.normal(size=k) * 2, True
    first = np.zeros((3, 6), bool)
    first[:, 0] = True
    p, pair = T._expect(e, on, first, trans)
    slow = [slow_chain(e[i, :k], trans) for i, k in enumerate(n)]
    for i, k in enumerate(n):
        assert np.allclose(p[i, :k], slow[i][0])
    assert np.allclose(pair, sum(s[1] for s in slow))


def test_marks_are_those_of_a_plain_count():
    r = np.random.default_rng(2)
    of = np.array([T.features(f"w{i}") for i in range(30)])
    docs = [r.integers(0, 30, r.integers(1, 12)) for _ in range(300)]
    y = np.array([int(3 in d or (5 in d and r.random() < 0.3)) for d in docs])
    mark = T._marking(docs, of, y)
    for f in np.unique(of):
        has = [bool((of[d] == f).any()) for d in docs]
        tox, all_ = sum(h and t for h, t in zip(has, y, strict=True)), sum(has)
        rate, base = tox / max(all_, 1), y.mean()
        gain = tox * math.log(max(rate, 1e-12) / base) + (all_ - tox) * math.log(max(1 - rate, 1e-12) / (1 - base))
        assert bool(mark[f]) == (f != 0 and tox >= 4 and rate >= 0.6 and gain >= 11.5)
    assert mark[of[3][0]] and not mark[of[7][0]]


def test_score_is_the_layer_on_enumerated_marginals():
    r = random.Random(5)
    say = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    texts = [say(12) + (" vile" if i % 4 == 0 else "") for i in range(400)]
    tagger = T.fit(texts, [int(i % 4 == 0) for i in range(400)])
    for text in ("w1 vile w2", "w3 w4", "vile", "w1 w2 w3 vile vile w9"):
        tokens = text.split()
        p, _ = slow_chain(tagger.emissions(tokens), tagger.trans)
        x = np.array([1, math.log1p(p.sum()), p.max(), math.log1p(100 * p.sum() / len(p))])
        want = 1 / (1 + math.exp(-x @ tagger.layer))
        got = tagger.score(T.summaries(tagger, [text])[0])[0]
        assert abs(got - want) < 1e-6 and (got >= 0.7) == ("vile" in tokens)
    x, y = np.random.default_rng(1).normal(size=(50, 3)), np.arange(50) % 2
    w = T.logistic(x, y)
    assert np.allclose(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.05 * w, 0, atol=1e-6)  # the penalised likelihood's gradient


def test_training_sample_is_bounded_in_bytes_and_clashing_names_stay(spark):
    docs = spark.createDataFrame([(i, "word " * 100, 0.5, "x") for i in range(60)], "doc_id long, text string, score double, spans string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert T.training_rows(docs, labels).count() > 30
    assert T.training_rows(docs, labels, most_bytes=5000).count() == 10
    out = T.score_toxicity(docs, T.fit([], []))
    assert out.columns == ["doc_id", "text", "score", "spans", "score_1", "spans_1"]
    assert {(r.score, r.spans, r.score_1) for r in out.collect()} == {(0.5, "x", 0.0)}


def test_sample_is_cut_by_sizes_before_texts(spark):
    rows = [(i, "x" * 1000) for i in range(200)] + [(7, "y" * 10), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = T.training_rows(docs, labels, 100, 20_000).collect()
    assert 15 <= len(got) <= 40 and sum(len(r.text or "") for r in got) <= 20_000
    plan = T.training_rows(docs, labels, 100, 20_000)._jdf.queryExecution().optimizedPlan().toString()
    cut = plan[plan.index("GlobalLimit 200") :]
    assert "text" not in cut.split("Aggregate")[0]  # what is ordered and limited has sizes only
