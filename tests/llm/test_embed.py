"""Links of near vectors against brute force, with clusters that overlap and clusters dealt into shards."""

import numpy as np
import pytest

from quillspark.llm import embed_dedup as E


def brute(rows):
    ok = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            ok[i] = (label, x / np.linalg.norm(x))
    near = {i: {j for j in ok if j != i and ok[j][0] == ok[i][0] and len(ok[j][1]) == len(ok[i][1]) and ok[i][1] @ ok[j][1] >= 0.93} for i in ok}
    out = {}
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


def vectors(n, seed=0):
    r = np.random.default_rng(seed)
    rows, base = [], r.normal(size=(n // 8, 16))
    for i in range(n):
        v = base[r.integers(len(base))] * r.choice([1, 3]) + r.normal(size=16) * 0.15 if r.random() < 0.6 else r.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(2))))
    rows += [(10_000 + k, rows[k][1], rows[k][2]) for k in range(0, 40, 2)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e-30] * 16, [1.0] * 16, [1.0] * 8]
    rows += [(20_000 + k, v, 1) for k, v in enumerate(bad)] + [(20_100, rows[0][1], None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, label int, node string, copies int")


@pytest.mark.parametrize("target,most", [(10_000, 2000), (60, 2000), (10_000, 150)])
def test_links(spark, monkeypatch, target, most):
    rows = vectors(600)
    monkeypatch.setattr(E, "MOST", most)
    fit = E.fit_pivots
    monkeypatch.setattr(E, "fit_pivots", lambda nodes: fit(nodes, target))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_dedup(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    found, true = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert found >= 0.98 * true and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    if target > 600 and most > 600:
        assert got == want


def test_audit_sees_missing_links(spark):
    _, nodes = E.nodes_of(frame(spark, vectors(300)))
    found = E.near_links(nodes, pivots=E.fit_pivots(nodes))
    counts = found.where("to is null").groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "links")
    assert E.audit(nodes, counts) > 0.97
    assert E.audit(nodes, counts.where("node % 2 = 0")) < 0.9


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    r = np.random.default_rng(4)
    big, pairs = r.normal(size=16), [r.normal(size=16) for _ in range(60)]
    rows = [(i, [float(x) for x in big + r.normal(size=16) * 0.02], 0) for i in range(120)]
    rows += [(1000 + 2 * k + j, [float(x) for x in v + r.normal(size=16) * 0.02], 0) for k, v in enumerate(pairs) for j in (0, 1)]
    _, nodes = E.nodes_of(frame(spark, rows))
    found = E.near_links(nodes, pivots=E.fit_pivots(nodes))
    counts = found.where("to is null").groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "links")
    assert E.audit(nodes, counts) > 0.97
    assert E.audit(nodes, counts.where("node < 1000")) < 0.6


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(E, "audit", lambda *_: 0.1)
    monkeypatch.setattr(E, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        E.embedding_dedup(frame(spark, vectors(40)))


def test_empty_and_repeated(spark):
    rows = vectors(40)
    assert E.embedding_dedup(frame(spark, rows).where("vec_id < 0")).count() == 0
    again = frame(spark, rows + rows[:5] + [(None, rows[0][1], 0)])
    assert E.embedding_dedup(again).count() == len(rows)
