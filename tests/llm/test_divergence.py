"""Source divergence against dense enumeration of all kept terms; edges."""

import random
import re
from collections import Counter

from quillspark.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs=30, prior=5, scale=10**9, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs, count = Counter(), {s: Counter() for _, g, s in rows if g == lang}
        for text, g, s in rows:
            if g == lang:
                found = TERM.findall(text.translate(LOWER))
                docs.update(set(found))
                count[s].update(found)
        kept = [t for t, n in docs.items() if n >= least_docs]
        count[None] = sum(count.values(), Counter())
        size = {s: sum(c[t] for t in kept) + prior * len(kept) for s, c in count.items()}
        p = {s: {t: 1 + scale * (c[t] + prior) // size[s] for t in kept} for s, c in count.items()}
        for s in count.keys() - {None}:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count.keys() - {s, None}]
            terms = [(p[s][t] - p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


def run(spark, rows, **more):
    return [tuple(r) for r in D.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), **more).collect()]


def check(spark, rows, **more):
    got, want = run(spark, rows, **more), plain(rows, **more)
    assert len(got) == len(set(got)) and set(got) == want
    return got


def corpus(seed=2, n=400):
    r = random.Random(seed)
    words = ["the", "The", "É", "é", "a-b", "x1y", "λόγος", "_", "zz", "it's", *("".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(300))]
    text = lambda: " ".join(words[min(int(r.expovariate(0.03)), len(words) - 1)] for _ in range(r.randint(0, 60)))
    return [(text(), r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "b", "c", None, "", "É", "z"])) for _ in range(n)]


def test_equals_dense_enumeration(spark):
    got = check(spark, corpus())
    assert {x[2] for x in got} == {"pair", "term"} and max(x[4] for x in got) > 0
    check(spark, corpus(3), least_docs=2, prior=1, scale=10_000, top=3)


def test_no_kept_terms_and_groups_without_terms(spark):
    rows = corpus(5) + [("", "en", "silent"), (None, "en", "mute"), ("9 8 7", "fr", "a"), ("un deux", "fr", "b"), ("solo", "it", "one")]
    got = check(spark, rows)
    assert {x[4] for x in got if x[0] == "fr"} == {0} and not [x for x in got if x[0] == "it"]
    assert [x for x in got if x[1] == "mute" and x[2] == "pair" and x[3] == "silent"][0][4] == 0


def test_repeated_rows_are_documents_and_ties_rank_by_item(spark):
    rows = [("alpha beta", "en", "s")] * 30 + [("gamma delta É", "en", "t")] * 30 + [("rare", "en", "t")] * 29
    got = check(spark, rows)
    assert [x[3] for x in sorted(got, key=lambda x: x[5]) if x[1] == "t" and x[2] == "term"] == ["delta", "gamma", "É"]


def test_huge_counts_do_not_overflow(spark):
    n = 10**13
    got = spark.range(1).select(D._share(D.F.lit(n), D.F.lit(3 * n), 5, 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (3 * n)


def test_long_texts_in_pieces_flushes_and_extra_columns(spark, monkeypatch):
    long = "Word " * 400_000 + "été" * 5
    assert sum(len(x) for x in D._pieces(long.encode())) == 400_001 and len(list(D._pieces(long.encode()))) == 2
    rows = [(long, "en", "a")] + [("word other", "en", "b")] * 40
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "text string, lang string, source string, v int, p string")
    assert {tuple(r) for r in D.divergence(docs).collect()} == plain(rows)
    assert D.divergence(docs.where("v = 2")).count() == 0
