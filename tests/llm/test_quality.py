"""Perplexities, thresholds and decisions against a plain version; edges."""

import math
import random

import numpy as np
from test_words import plain_log_p

from quillspark.llm import kn_quality as K


def test_query_is_brute_force(spark):
    """Perplexities, thresholds and decisions of every document against the definition."""
    r = random.Random(8)
    v = {"a": ["".join(r.choices("abcde", k=3)) for _ in range(12)], "б": ["".join(r.choices("бвгд", k=3)) for _ in range(12)]}
    rows = [(i, " ".join(r.choices(v[lang], k=r.randint(3, 40))), lang) for lang in v for i in range(100 * (lang == "б"), 100 * (lang == "б") + 60)]
    rows += [(300, None, "a"), (301, " ", "a"), (302, rows[0][1], None), (303, rows[0][1], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = {i for i, *_ in rows if i % 100 < 45 and i < 200}
    labels = spark.createDataFrame([(i, int(i in good)) for i, *_ in rows], "doc_id long, quality int")
    fold = {x.doc_id: x.f for x in docs.selectExpr("doc_id", "cast(pmod(xxhash64(cast(doc_id as string), 'fold'), 2) as int) f").collect()}
    trained = [[t for i, t, _ in rows if i in good and fold[i] == f] for f in (0, 1)]
    log = {i: plain_log_p(trained[1 - fold[i]], t) if t and t.strip() else None for i, t, _ in rows}
    size = lambda t: 0 if len(t or "") < 64 else 1 if len(t) < 256 else 2

    def limit(keep, least=20):
        own = sorted(math.ceil(log[i] / 1e-4) for i, t, lang in rows if i in good and keep(t, lang))
        return own[math.ceil(len(own) * 0.99) - 1] * 1e-4 if len(own) >= least else None

    for g in K.quality(docs, labels).collect():
        t, lang = next((t, lang) for i, t, lang in rows if i == g.doc_id)
        at = (
            limit(lambda x, y: y == lang and size(x) == size(t)) or limit(lambda x, _: size(x) == size(t))
            or limit(lambda _, y: y == lang) or limit(lambda *_: True, 1)
        )
        assert abs(math.log(g.threshold) - at) < 2e-4 and g.trusted == (g.doc_id in good), g
        if log[g.doc_id] is None:
            assert g.perplexity is None and not g.kept
        else:
            assert abs(math.log(g.perplexity) - log[g.doc_id]) < 1e-5
            assert g.kept == (log[g.doc_id] <= at) or abs(log[g.doc_id] - at) < 2e-4


def test_junk_has_a_higher_perplexity(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = K.quality(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == labels.count()
    share = lambda q: np.mean([r.kept for r in got if r.quality == q])
    assert share(1) > 0.97 and share(0) < 0.3


def test_thresholds_and_edges(spark):
    rows = [("a", x / 100) for x in range(1, 101)] + [("b", 5.0)] * 3 + [(None, None)]
    got = {r.lang: r.limit for r in K.thresholds(spark.createDataFrame(rows, "lang string, log_perplexity double"), ["lang"], 0.9).collect()}
    assert abs(got["a"] - 0.9) < 2e-4 and "b" not in got and None not in got
    docs = spark.createDataFrame([(1, "good text", "en"), (1, "good text", "en"), (2, None, None), (3, "", "en"), (4, "other", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (2, 0)], "doc_id long, quality int")
    out = {(r.doc_id, r.kept, r.perplexity is None) for r in K.quality(docs, labels).collect()}
    assert {(1, True, False), (2, False, True), (3, False, True)} <= out and K.quality(docs, labels).count() == 5
    assert {r.kept for r in K.quality(docs, labels.where("quality = 7")).collect()} == {False}
    assert K.quality(docs.where("doc_id = 99"), labels).count() == 0
