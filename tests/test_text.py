"""Scalar text functions on literals."""

import pytest
from oracle import compare
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.plans import ORACLE, QUERIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(s):
    return F.lit(s).cast("string")


def test_sentence_chunks(spark):
    assert one(spark, T.chunk_sentence(lit("The cat sat. The dog ran."))) == ["The cat sat.", "The dog ran."]
    assert one(spark, T.chunk_sentence(lit("   "))) == []
    assert one(spark, T.chunk(lit("Alpha. Beta."), "no such strategy")) == ["Alpha.", "Beta."]
    assert one(spark, T.chunk(lit("Alpha. Beta."), "none")) == ["Alpha. Beta."]


def test_paragraphs_and_sections(spark):
    assert one(spark, T.chunk_paragraph(lit("a b.\n\nc d.\n \ne f."))) == ["a b.", "c d.", "e f."]
    doc = "## One\nalpha.\n### Two\nbeta.\n## Three\ngamma.\n## Four\ndelta."
    assert one(spark, T.chunk_section(lit(doc))) == ["## One\nalpha.", "### Two\nbeta.", "## Three\ngamma.", "## Four\ndelta."]
    early = lit("before\n## One\nalpha.")
    assert one(spark, T.chunk_section(early)) == ["## One\nalpha."]
    assert one(spark, T.chunk_section(early, keep_preamble=True)) == ["before", "## One\nalpha."]
    big = "## H\n" + "word one two. " * 40
    cut = one(spark, T.chunk_section(lit(big), 20, 0))
    assert len(cut) == 40 and all(c.startswith("## H\n\n") for c in cut)


def test_long_sentences_stay_whole_without_a_cut(spark):
    long = "word " * 130 + "end."
    text = f"Short one. {long} Last."
    assert one(spark, T.chunk_paragraph(lit(text), 128, 16, cut=False)) == ["Short one.", long, "Last."]
    assert one(spark, T.chunk_section(lit("## H\n" + text), 128, 16, cut=False)) == [f"## H\n\n{x}" for x in ("Short one.", long, "Last.")]
    assert len(one(spark, T.chunk_paragraph(lit(text), 128, 16))) > 3


@pytest.mark.parametrize("name", ["chunk_paragraph", "chunk_section"])
def test_talks_of_long_sentences_match_their_sql(spark, tmp_path, name):
    rows = [(1, 0, "user", "word " * 130 + "end. Next one."), (1, 1, "assistant", "Short."), (2, 0, "user", "A b. " * 200)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).toPandas().to_parquet(tmp_path / "conversations.parquet")
    assert compare(spark, str(tmp_path), QUERIES[name], ORACLE[name]) > 3


def test_fixed_windows(spark):
    assert len(one(spark, T.chunk_fixed(lit("x" * 1000), 500, 100))) == 1
    assert [len(c) for c in one(spark, T.chunk_fixed(lit("a" * 6000), 500, 100))] == [2000, 2000, 2000, 1200]
    assert one(spark, T.chunk_fixed(lit(""))) == []


def split_by_hand(text, size, overlap, sep=" "):
    most, carried = size * 4, max(1, overlap * 4 // (len(sep) + 8)) if overlap else 0
    if len(text) <= most:
        return [text.strip()] if text.strip() else []
    out, start, n = [], 0, 0
    units = text.split(sep)
    for i, u in enumerate(units):
        if i > start and n + len(u) + 1 > most:
            out.append(sep.join(units[start:i]))
            start = max(start, i - carried) if carried else i
            n = sum(len(x) + 1 for x in units[start:i])
        n += len(u) + 1
    return [c for c in (x.strip() for x in [*out, sep.join(units[start:])]) if c]


def test_long_sentences_carry_their_last_words(spark):
    text = " ".join(f"w{i}" for i in range(700))
    for size, overlap in ((50, 0), (50, 8), (128, 64)):
        assert one(spark, T.split_long(lit(text), size, overlap)) == split_by_hand(text, size, overlap)


def test_token_estimate_rounds_half_to_even(spark):
    assert [one(spark, T.token_estimate(lit("x" * n))) for n in (0, 2, 6, 10, 2050)] == [1, 1, 2, 2, 512]


def test_sentence_windows(spark):
    text = " ".join(f"s{i} a b c." for i in range(10))
    w = one(spark, T.windows_of_sentences(lit(text), 12, 1))
    assert w[0] == "s0 a b c. s1 a b c. s2 a b c." and w[1].startswith("s2 ") and w[-1].endswith("s9 a b c.")


def test_routes(spark):
    for q, path in (
        ("who reported BUG-204?", "graph"), ("why did the checkout service fail?", "hybrid"), ("when was it released", "graph"),
        ("What is the design of this", "hybrid"), ("what " + "x " * 9, "hybrid"),
    ):
        assert one(spark, T.route(lit(q))) == path, q
    assert one(spark, T.rewrite(lit("What is the cause of failure"))) == "cause failure"
    assert one(spark, T.rewrite(lit("what is the"))) == "what is the"


def test_names(spark):
    assert one(spark, T.normal_name(lit("[DIAGNOSIS CANDIDATE] Measles (disorder) (SNOMED 1)\nx"))) == "measles (disorder)"
    assert one(spark, T.entity_name(lit(' "Zhang et al.", '))) == '"Zhang et al'
    assert one(spark, T.relation_type(lit("depends-on"))) == "DEPENDS_ON"
    assert one(spark, T.relation_type(lit("9 lives"))) == "REL_9_LIVES"
    assert one(spark, T.account_id(lit("Is ACCT Alpha_1 ok"))) == "alpha_1"
    assert one(spark, T.account_id(lit("none"))) is None
    for name, ok in (("BM25", True), ("Late chunking", True), ("late chunking", False), ("is faster", False), ("A B C D", False), ("", False)):
        assert one(spark, T.plausible_entity(lit(name))) is ok, name
    assert [one(spark, T.confidence(F.lit(x))) for x in (0.5, 0.15, 0.1)] == ["high", "medium", "low"]
    assert [one(spark, T.infer_domain(lit(p))) for p in ("a.PDF", "x/papers/a.md", "a/legal/b.md", "q.md")] == ["journal", "journal", "legal", C.DEFAULT_DOMAIN]


def test_profiles_and_prompts(spark):
    text = lit("One. Two names Kafka here. Three. Four. Five.")
    assert one(spark, T.profile_text(lit("kafka"), text, 1)) == "One. Two names Kafka here. Three."
    assert one(spark, T.profile_text(lit("big Kafka"), text)) == "Two names Kafka here."
    assert one(spark, T.profile_text(lit("zzz"), text)) == ""
    p = one(spark, T.synthesis_prompt(lit("why?"), F.array(lit("a"), lit("GRAPH EDGE: A -[R]-> B"))))
    assert p.startswith("Some contexts are relationships") and "[2] GRAPH EDGE" in p and p.endswith("QUESTION: why?")
    assert one(spark, T.synthesis_prompt(lit("q"), F.array(lit("a")), template="{query}|{context}")) == "q|[1] a"
    assert one(spark, T.metadata_warnings(F.create_map(lit("a"), lit("1"), lit("zz"), lit("2")), ["a"], "d")) == ["metadata field 'zz' not in profile schema for domain 'd'"]
    assert one(spark, T.metadata_warnings(F.create_map(lit("a"), lit("1")), [], "d")) == []
    assert one(spark, T.golden_truth(lit("a b c one two three four five six seven eight nine ten eleven twelve"))).startswith("one two")


def test_nulls_stay_null(spark):
    for f in (T.sentences, T.tokens, T.keywords, T.chunk_sentence, T.chunk_fixed, T.normal_name):
        assert one(spark, f(lit(None))) in (None, []), f
