"""Table functions in SQL: against the Column functions, on edge cases and in their plans."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import tables
from quillspark.functions import text as T

TEXTS = [None, "", "  ", "One two. Three four! Five?\nSix", "a" * 600, "word " * 1500, "tab\tand  blanks ", "it's a \\ slash. Grüße! 漢字。"]


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


@pytest.mark.parametrize(
    "call, column",
    [
        ("sentence_rows(d.text)", lambda t: T.sentences(t)),
        ("fixed_chunks(d.text)", lambda t: T.chunk_fixed(t)),
        ("fixed_chunks(d.text, 8, 2)", lambda t: T.chunk_fixed(t, 8, 2)),
        ("fixed_chunks(d.text, 8, 9)", lambda t: T.chunk_fixed(t, 8, 9)),
        ("word_windows(d.text)", lambda t: T.chunk_words(t)),
        ("word_windows(d.text, 7, 3)", lambda t: T.chunk_words(t, 7, 3)),
    ],
)
def test_chunkers_equal_the_columns(spark, docs, call, column):
    got = spark.sql(f"SELECT d.doc_id, c.chunk_idx, c.chunk FROM {{d}} d, LATERAL {call} c", d=docs)
    want = docs.select("doc_id", F.posexplode(column(F.col("text"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().toString()


def test_filters_reach_the_scan(spark, sf_dir):
    tables.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = spark.sql("SELECT d.doc_id, c.chunk FROM {d} d, LATERAL fixed_chunks(d.text) c WHERE d.lang = 'en'", d=docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan


def test_ranked_hits(spark):
    tables.register(spark)
    rows = [(1, 0.5, 1, "a"), (1, 0.9, 2, "b"), (1, 0.9, 1, "c"), (1, None, 3, "d"), (2, None, 1, "e"), (None, 0.1, 1, "f")]
    hits = spark.createDataFrame(rows, "qid int, score double, arrival int, text string")
    ask = lambda h, k=2: spark.sql(f"SELECT * FROM ranked_hits(TABLE({{h}}), {k})", h=h)
    got = {(r.qid, r.text, r["rank"]) for r in ask(hits).collect()}
    assert got == {(1, "c", 1), (1, "b", 2), (2, "e", 1), (None, "f", 1)}
    assert ask(hits.where("false")).count() == 0
    assert ask(hits, 100).count() == len(rows)
    for bad, k in ((hits.drop("score"), 2), (hits.withColumn("rank", F.lit(1)), 2), (hits, 0)):
        with pytest.raises(Exception, match="ranked_hits"):
            ask(bad, k).collect()


def test_retriever(spark):
    facts = [("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 1.0), ("b", "w", None), (None, "n", 9.0)]
    tables.register_retriever(spark, "test_facts", spark.createDataFrame(facts, "subject string, fact string, weight double"), 2)
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "s string, weight int")
    out = spark.sql("SELECT q.weight AS n, f.fact, f.rank FROM {q} q, LATERAL test_facts(q.s) f", q=asked)
    tables.drop_retriever(spark, "test_facts")
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "x", 2), (1, "y", 1), (2, "x", 2), (2, "y", 1), (3, "w", 1)]
