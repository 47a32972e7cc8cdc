"""Search by the impact-ordered index against whole scores; how much of the lists it reads."""

import random
from collections import Counter

import pytest

from quillspark.operators import sparse_index as S
from quillspark.operators.search import term_top_k


def corpus(seed=1, n=600, colls=("a", "b")):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bins = Counter(min(int(r.expovariate(0.08)), 90) for _ in range(r.randint(0, 25)))
        rows += [(r.choice(colls) if len(colls) > 1 and i % 7 else colls[0], i, b, float(c)) for b, c in bins.items()]
    one = {}  # a vector is in one collection
    return [(one.setdefault(i, c), i, b, t) for c, i, b, t in rows]


def plain(queries, rows, k, decimals=6):
    score = Counter()
    for q, b, w in queries:
        for c, i, x, t in rows:
            if b == x and w and w > 0 and t and t > 0:
                score[q, c, i] += w * t
    out = set()
    for g in {x[:2] for x in score}:
        ranked = sorted(((round(s, decimals), x[2]) for x, s in score.items() if x[:2] == g), key=lambda x: (-x[0], x[1]))[:k]
        out |= {(*g, i, s, n + 1) for n, (s, i) in enumerate(ranked)}
    return out


def build(spark, rows, **more):
    return S.build_index(spark.createDataFrame(rows, "coll string, id long, idx int, tf double"), **more)


def run(spark, queries, index, k):
    return {(r.qid, r.coll, r.id, r.score, r["rank"]) for r in S.sparse_top_k(spark.createDataFrame(queries, "qid int, idx int, weight double"), index, k).collect()}


@pytest.mark.parametrize("block", [1, 8, 64])
def test_equals_whole_scores(spark, block):
    r, rows = random.Random(9), corpus()
    queries = [(q, b, float(r.choice([1, 1, 2, 0.3]))) for q in range(12) for b in r.sample(range(95), r.randint(1, 9))]
    index = build(spark, rows, block=block)
    for k in (1, 5):
        assert run(spark, queries, index, k) == plain(queries, rows, k)


def test_a_common_bin_is_not_read_to_its_end(spark):
    r = random.Random(3)
    rows = [("a", i, 0, 1.0) for i in range(4000)] + [("a", i, 1, float(r.randint(1, 9))) for i in range(0, 4000, 4)] + [("a", i, 2, 50.0) for i in range(0, 400, 20)]
    queries = [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]
    index = build(spark, rows)
    assert run(spark, queries, index, 5) == plain(queries, rows, 5)
    got = S.postings_read(spark.createDataFrame(queries, "qid int, idx int, weight double"), index, 5).first()
    assert got.n_all == len(rows) and got.n_read < 400
    assert index.blocks.agg({"n": "max"}).first()[0] <= S.BLOCK and index.blocks.where("idx = 0").count() >= 4000 // S.BLOCK


def test_ties_at_the_threshold_go_to_the_smaller_id(spark):
    rows = [("a", i, b, 1.0) for i in range(500) for b in (1, 2)]
    queries = [(1, 1, 1.0), (1, 2, 1.0)]
    assert [x[2] for x in sorted(run(spark, queries, build(spark, rows), 7), key=lambda x: x[4])] == list(range(7))


def test_edges(spark):
    rows = [("a", 1, 3, 2.0), ("a", 1, 3, 1.0), ("a", 2, 3, None), ("a", 3, 3, -1.0), (None, 4, 3, 1.0), ("b", 5, 9, 1.0)]
    index = build(spark, rows)
    assert run(spark, [(1, 3, 1.0), (1, 3, 1.0), (2, 3, None), (3, 77, 1.0), (4, 9, 0.0)], index, 5) == {(1, "a", 1, 6.0, 1)}
    assert run(spark, [], index, 5) == set() and run(spark, [(1, 3, 1.0)], build(spark, []), 5) == set()


def test_term_search_in_blocks_equals_one(spark, monkeypatch):
    from quillspark.operators import search

    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    chunks = spark.createDataFrame([(i // 3, i % 3, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(300)], "doc_id long, chunk_idx long, text string")
    asked = spark.createDataFrame([(q, " ".join(r.choices(words, k=4))) for q in range(9)] + [(99, ""), (98, "unknown")], "qid long, text string")
    one = sorted(term_top_k(asked, chunks, 4, 100).collect())
    monkeypatch.setattr(search, "BLOCK_VALUES", 64)
    assert sorted(term_top_k(asked, chunks, 4, 100).collect()) == one and {r.qid for r in one} == set(range(9))


def test_rows_below_the_bound_are_not_scored_and_ties_stay():
    """Rows of common tokens only are left out once k better ones are known; the k best equal those of every row scored."""
    import numpy as np
    import pyarrow as pa

    from quillspark.operators import search

    n, rng = 64, np.random.default_rng(4)
    ends = np.concatenate([[0], [n], n + np.arange(1, n + 1)])
    postings = ends, np.concatenate([np.arange(n), np.arange(n)]), np.concatenate([np.full(n, 0.1), np.full(n, 5.0)])
    known = pa.array(["the", *(f"t{i}" for i in range(n))])
    rows = [["the", f"t{i % n}"] for i in range(3 * n)] + [["the"] * int(rng.integers(1, 4)) for _ in range(5000)] + [["the", "t3", "t3"], ["x"], []]
    best, every, bounds, scored = search._Best(2), search._Best(2), search._Bounds(*postings, n), 0
    best.widen(n), every.widen(n)
    for s in range(0, len(rows), 100):
        part = pa.array(rows[s : s + 100], pa.list_(pa.string()))
        at, token = search._coded(part, known)
        may = bounds.rows(at, token, np.zeros(len(part), np.int64), best, 1e-6)
        scored += len(may)
        row, q, score = search._matches(at, token, *postings, len(part), n)
        every.add(q, score, row + s)
        own = np.isin(row, may)
        best.add(q[own], score[own], row[own] + s)
        best._cut(), every._cut()
    assert all((a == b).all() for a, b in zip(best.take(), every.take(), strict=True)) and scored < 500


def test_documents_of_a_token_are_counted_once(spark, monkeypatch):
    from quillspark.operators import search

    rows = [(1, ["a", "b", "a"]), (1, ["a"]), (2, ["a", "z"]), (None, ["a"]), (3, None), (4, [])]
    said = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "token string")
    for values in (8_000_000, 16):
        monkeypatch.setattr(search, "BLOCK_VALUES", values)
        assert {tuple(r) for r in search.document_frequencies(asked, said).collect()} == {("a", 2), ("b", 1)}
