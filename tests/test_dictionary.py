"""Dictionary matching against a regular expression of all names; shards; sizes."""

import random
import re

from quillspark.operators import dictionary as D


def plain(docs, names):
    label = {}
    for n, x in names:
        if n:
            label[n.lower()] = min(label.get(n.lower(), x or ""), x or "")
    inner = "|".join((r"(?<!\w)" if n[0].isalnum() or n[0] == "_" else "") + re.escape(n) + (r"(?!\w)" if n[-1].isalnum() or n[-1] == "_" else "") for n in sorted(label, key=len, reverse=True))
    return {(d, m.start(), m.end(), m[0], label[m[0].lower()]) for d, t in docs for m in re.finditer(inner, t or "", re.I)}


def run(spark, docs, names, **how):
    docs, names = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "name string, label string")
    return [tuple(r) for r in D.dictionary_spans(docs, names, **how).collect()]


def corpus(seed):
    r = random.Random(seed)
    words = ["ab", "abc", "bc", "c", "ca-b", "Été", "naïve", "x1", "_y", "C++", "the", "of"]
    names = {" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(60)}
    docs = [(i, r.choice(["", ". ", "-"]).join([r.choice(words).upper() if r.random() < 0.3 else r.choice(words), " "][k % 2] for k in range(r.randint(0, 60)))) for i in range(60)]
    return docs, [(n, r.choice("xyz")) for n in sorted(names)]


def test_equals_the_regular_expression_however_it_is_dealt(spark):
    docs, names = corpus(2)
    want = plain(docs, names)
    assert len(want) > 200
    for size in (1 << 20, 200, 40):
        got = run(spark, docs, names, shard_bytes=size)
        assert len(got) == len(set(got)) and set(got) == want


def test_edges(spark):
    names = [("New York", "city"), ("new york", "a"), ("York", "city"), ("york city", "x"), ("", "x"), (None, "x"), ("İx", "t"), ("no label", None)]
    docs = [(1, "new YORK City"), (2, None), (3, ""), (4, "NewYork york_ york"), (5, "say İX İx"), (None, "no label"), (6, "york"), (6, "york")]
    got = run(spark, docs, names)
    assert sorted(got, key=str) == sorted(
        [(1, 0, 8, "new YORK", "a"), (4, 14, 18, "york", "city"), (5, 7, 9, "İx", "t"), (None, 0, 8, "no label", ""), (6, 0, 4, "york", "city"), (6, 0, 4, "york", "city"), (5, 4, 6, "İX", "t")], key=str
    )
    assert run(spark, docs, []) == [] and run(spark, [], names) == []
    assert D.folded("İ") == "İ" and len(D.folded("Straße İ")) == 8


def test_a_hundred_thousand_names_in_one_pass_a_text():
    names = [(f"name{i} of {i % 7}", "n") for i in range(100_000)]
    automaton = D.Automaton(names)
    text = " and ".join(f"name{i} of {i % 7}" for i in range(0, 100_000, 100))
    assert len(list(automaton.spans(text))) == 1000
    assert list(D.Automaton([("a" * 50, "x")]).spans("a" * 100_000)) == []  # no backtracking, no partial words
