"""Targets and words taken against a plain version."""

import hashlib
import random
import re

from quillspark.llm import mixing as M


def plain(rows, packet=25):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    budget, capped = 1.5 * sum(total.values()), set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (budget - 2 * sum(total[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * total[s] if s in capped else level * weight[s] for s in sources}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    packets = []
    for nth, s in enumerate(sources):
        mine = (i for i, r in enumerate(rows) if r[2] == s)
        queue = sorted(mine, key=lambda i: md5(f"42:{'' if rows[i][0] is None else rows[i][0]}:{md5(rows[i][1] or '')}"))
        at = 0
        for k in range(2):
            for i in queue:
                for p in range(0, size[i], packet):
                    n = min(packet, size[i] - p)
                    packets.append(((at + p + n) / target[s], nth, at + p, n, i))
                at += size[i]
    taken, left = [0] * len(rows), int(budget)
    for *_, n, i in sorted(packets):
        taken[i] += min(n, left)
        left -= min(n, left)
    return size, total, target, taken


ROWS = [(i, "w " * (i * 37 % 50), ["b", "a", None, "é", "Z", "big"][i % 6 if i % 2 else 5]) for i in range(200)] + [(900, None, "a"), (901, "", None), (902, "only", "tiny")]


def test_mix(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    size, total, target, taken = plain(ROWS)
    got = {r.doc_id: r for r in M.mix_sources(docs).collect()}
    assert len(got) == len(ROWS)
    for r, n, t in zip(ROWS, size, taken, strict=True):
        g = got[r[0]]
        assert (g.size, g.source_size, g.taken) == (n, total[r[2]], t) and abs(g.target - target[r[2]]) < 1e-6
        assert g.taken <= 2 * g.size
    for s in total:
        mine = sum(got[r[0]].taken for r in ROWS if r[2] == s)
        assert abs(mine - target[s]) <= 25


def test_smaller_packets_come_nearer(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    _, _, target, taken = plain(ROWS, 7)
    got = {r.doc_id: r.taken for r in M.mix_sources(docs, packet=7).collect()}
    assert [got[r[0]] for r in ROWS] == taken
    assert all(abs(sum(n for n, r in zip(taken, ROWS, strict=True) if r[2] == s) - target[s]) <= 7 for s in target)


def test_the_mix_is_what_is_taken_in_order(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 9 * 30)), "abc"[i % 3 if i < 60 else 0]) for i in range(90)]
    docs = spark.createDataFrame([(*r, len(r[1]), 1, "x") for r in rows], "doc_id long, text string, source string, n_chars int, finish int, size string")
    taken = {r.doc_id: r.taken for r in M.mix_sources(docs).collect()}
    out = M.mixed(docs)
    assert out.columns == [*docs.columns, "pass", "words", "finish_1", "size_1", "target"]
    out = out.collect()
    assert [r.finish_1 for r in out] == sorted(r.finish_1 for r in out)
    for d, t, s in rows:
        mine = sorted((r for r in out if r.doc_id == d), key=lambda r: r["pass"])
        assert sum(r.words for r in mine) == taken[d] and all(r.words and r.source == s for r in mine)
        for r in mine:
            assert r.text.split() == t.split()[: r.words] and r.n_chars == len(r.text) and (r.finish, r["size"]) == (1, "x")
            assert r.words < r.size_1 or r.text == t
    assert {r["pass"] for r in out} == {0, 1}


def test_rows_without_an_id_are_shuffled_by_their_text(spark):
    rows = [(None, "w " * n + f"x{n}", "s") for n in range(40)] + [(i, "v " * 90, "t") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, _, _, taken = plain(rows)
    got = M.mix_sources(docs).collect()
    assert sorted((r.size, r.taken) for r in got if r.source == "s") == sorted((n + 1, t) for n, t in enumerate(taken[:40]))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None)], "doc_id long, text string, source string")
    assert M.mix_sources(docs).count() == 3
    assert M.mix_sources(docs.where("doc_id = 9")).count() == 0
    assert M.mix_sources(docs.selectExpr("doc_id", "cast(null as string) text", "source")).agg({"taken": "sum"}).first()[0] == 0


def test_whole_documents_and_packets_meet_at_the_edge_whatever_the_sizes(spark):
    for seed, longest in ((1, 3000), (2, 60), (3, 7)):
        r = random.Random(seed)
        rows = [(i, "w " * r.randint(0, 40), r.choice("aab")) for i in range(60)] + [(100 + i, "w " * longest, "abcd"[i]) for i in range(4)]
        size, total, target, taken = plain(rows)
        got = {x.doc_id: x.taken for x in M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert [got[x[0]] for x in rows] == taken
