"""What a round's findings were about: what is shuffled, how much a task holds, and that nothing is lost by it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import aliases, dictionary, evaluation, extraction, matching, resolution, search, terminology, terms, transactions


def shuffled(spark, run):
    """Bytes that the stages of a run write to shuffles."""
    store, gw = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        of = store.stageList(gw.jvm.java.util.ArrayList(), False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
        return {of.apply(i).stageId(): of.apply(i).shuffleWriteBytes() for i in range(of.size())}

    before = stages()
    out = run()
    return out, sum(n for i, n in stages().items() if i not in before)


def noise(seed, n):
    return "".join(map(chr, np.random.default_rng(seed).integers(97, 123, n)))


def test_texts_are_not_shuffled_for_substrings(spark):
    texts = [(i, noise(i, 3000)) for i in range(60)]
    needles = [(t[100:130],) for _, t in texts] + [(texts[0][1][7:9],)]
    n, t = spark.createDataFrame(needles, "needle string"), spark.createDataFrame(texts, "i int, hay string")
    got, size = shuffled(spark, lambda: {(r.needle, r.i) for r in matching.containing(n, t, "needle", "hay").collect()})
    assert got == {(w, i) for (w,) in needles for i, x in texts if w in x}
    assert size < 3000


def test_blocks_of_needles_give_what_one_gives(spark, monkeypatch):
    n = spark.createDataFrame([(w,) for w in ("a", "ab", "bc", "a long needle of many characters", "é")], "needle string")
    t = spark.createDataFrame([(1, "abc"), (2, "say a long needle of many characters é"), (3, None)], "i int, hay string")
    got = lambda: sorted((r.needle, r.i) for r in matching.containing(n, t, "needle", "hay").collect())
    one = got()
    monkeypatch.setattr(matching, "BLOCK_CHARS", 3)
    assert got() == one and len(one) == 6


def test_title_keeps_the_smallest_concept(spark):
    d = spark.createDataFrame([(9, "The cat sat", "en"), (3, "a THE CAT", "en"), (1, "the cat", "de"), (5, "the cat", "en")], "concept_id int, term string, language_code string")
    got = terminology.concept_of_title(spark.createDataFrame([("The cat",), ("none",), ("",)], "title string"), d).collect()
    assert [tuple(r) for r in got] == [("The cat", 3)]


def test_texts_meet_aliases_once(spark):
    texts = [(i, " ".join(noise(1000 * i + j, 8) for j in range(400)) + " the big apple") for i in range(40)]
    a = spark.createDataFrame([("the", "Article"), ("the big apple", "New York"), ("big", "new york"), ("apples", "Fruit")], "alias string, canonical string")
    q = spark.createDataFrame(texts, "qid int, text string")
    got, size = shuffled(spark, lambda: {r.qid: r.expanded for r in aliases.expand_queries(q, a).collect()})
    assert got == {i: f"{t} (New York; Article)" for i, t in texts}
    assert size < 3 * sum(len(t) for _, t in texts)


def test_entities_of_a_long_document_in_its_sentences(spark):
    names = [noise(i, 9) for i in range(3000)] + ["ab", "É"]
    text = ". ".join(f"{a} x{b.upper()}y" for a, b in zip(names[:2000:2], names[1:2000:2], strict=True)) + ". Éab"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    found = spark.createDataFrame([(1, n) for n in names] + [(2, "ab")], "doc_id int, name string")
    got = {(r.src, r.dst) for r in extraction.cooccurring(docs, found).collect()}
    want = set()
    for s in text.lower().split(". "):
        here = sorted(n for n in names if n.lower() in s)
        want |= {(a, b) for i, a in enumerate(here) for b in here[i + 1 :]}
    assert got == want


def test_a_task_keeps_its_own_best_and_holds_a_bounded_tile(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.integers(-2, 3, (300, 3)).astype(float)  # many ties
    vectors = spark.createDataFrame([(i, x.tolist(), int(i % 3)) for i, x in enumerate(v)], "id int, vector array<double>, g int").coalesce(1)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:50])], "qid int, vector array<double>")
    got = lambda: sorted(tuple(x) for x in search.top_k(queries, vectors, 4, ["g"], -0.5).collect())
    one = got()
    monkeypatch.setattr(search, "TILE", 64)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 16)
    assert got() == one
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    score = np.round(unit[:50] @ unit.T, 6)
    want = []
    for q in range(50):
        for g in range(3):
            best = sorted((-score[q, i], i) for i in range(300) if i % 3 == g and score[q, i] >= -0.5)[:4]
            want += [(q, i, g, -s, n + 1) for n, (s, i) in enumerate(best)]
    assert [x[:3] + x[4:] for x in one] == [x[:3] + x[4:] for x in sorted(want)]


def test_tokens_that_are_numbers_in_groups(spark):
    said = spark.createDataFrame([(1, "x", [5, 5, 7]), (2, "x", [7]), (3, None, [5]), (4, "x", []), (5, "x", [9])], "id long, coll string, tokens array<int>")
    weighted = spark.createDataFrame([(1, [(5, 2.0), (7, 1.0)]), (2, [(7, 1.0)])], "qid int, terms array<struct<token: int, weight: double>>")
    got = {(r.qid, r.coll, r.id, r.score, r["rank"]) for r in search.posting_top_k(weighted, said, ["id"], 1, ["coll"]).collect()}
    assert got == {(1, "x", 1, 5.0, 1), (1, None, 3, 2.0, 1), (2, "x", 1, 1.0, 1)}


@pytest.mark.parametrize("values", [4_000_000, 64])
def test_names_are_resolved_without_joining_vectors(spark, monkeypatch, values):
    from test_resolution import check, groups

    monkeypatch.setattr(resolution, "BLOCK_VALUES", values)
    names = groups(1, 150, 20, 0.25)
    nodes = [(f"old{i}", x[2]) for i, x in enumerate(names[:5])]
    check(spark, names, nodes, head=40)


def test_a_copy_takes_the_nearest_of_the_leaders_before_it(spark):
    from test_resolution import check

    turn = lambda t: [float(np.cos(t)), float(np.sin(t))]
    # d is a copy of b; c is nearer to it than a is, and comes after b.
    check(spark, [("a", "t", turn(0.0), 1), ("b", "t", turn(0.4), 2), ("c", "t", turn(0.6), 3), ("d", "t", turn(0.4), 4)])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hubs_are_made_distinct_by_a_sort(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), ("b", 1, ""), (None, 2, "x"), ("a", 3, "x"), (None, 2, "x")], "from string, device int, card string")
    got = transactions.hubs(t)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("a", "device", "1"), ("a", "card", "x"), ("b", "device", "1"), (None, "device", "2"), (None, "card", "x"), ("a", "device", "3")], key=str
    )
    assert "HashAggregate" not in plan(got)


def test_documents_of_a_token_are_counted_without_a_hash_map_of_postings(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, "b"), (None, "b"), (3, None)], "id int, token string")
    got = terms.idf(p, 4)
    assert {r.token: r.df for r in got.collect()} == {"a": 2, "b": 1, None: 1}
    assert "HashAggregate(keys=[token#" in plan(got) and ", id#" not in "".join(x for x in plan(got).split("\n") if "HashAggregate" in x)


def test_windows_come_to_python_in_bounded_batches(spark):
    from quillspark.operators.documents import per_window

    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for k in keys:
        spark.conf.unset(k)
    docs = spark.createDataFrame([(1, "One two. Three four. Five."), (2, None), (3, "")], "doc_id int, text string")
    assert [tuple(r) for r in per_window(docs, 3, 1).orderBy("doc_id", "idx").collect()] == [(1, 0, "One two. Three four.", None), (1, 1, "Three four. Five.", "One two. Three four.")]
    assert int(spark.conf.get(keys[0])) <= 2000 and int(spark.conf.get(keys[1]).rstrip("b")) <= 4 << 20


def test_an_automaton_takes_a_step_a_token_and_finds_whole_words():
    steps = 0

    class Counted(dict):
        def get(self, *a):
            nonlocal steps
            steps += 1
            return dict.get(self, *a)

    names = ["fox", "the fox", "c++", "++", "_x", "é", "fo", "a-b", "-b", "ab cd", " cd"]
    automaton = dictionary.Automaton([(n, n) for n in names])
    automaton.go = [Counted(x) for x in automaton.go]
    word = lambda c: c.isalnum() or c == "_"

    def plain(text):
        for n in names:
            for i in range(len(text) - len(n) + 1):
                j = i + len(n)
                if text[i:j] == n and not (i and word(text[i - 1]) and word(n[0])) and not (j < len(text) and word(n[-1]) and word(text[j])):
                    yield i, j, n

    rng = np.random.default_rng(5)
    parts = [*names, " ", "x", "+", "-", "é", "_", "\u0301", "²", "the", "\n"]
    for text in ["", "the fox", "c+++ c++ the foxes a-b", *("".join(rng.choice(parts, 30)) for _ in range(300))]:
        assert sorted(automaton.spans(text)) == sorted(plain(text))
    steps = 0
    assert not list(automaton.spans("abcdefghij " * 100)) and steps == 200


def test_metrics_make_embeddings_and_terms_once(spark):
    rows = spark.createDataFrame(
        [("red fox runs far", ["The red fox runs far. Nothing here.", "quite another thing"]), ("", ["a b"]), ("red fox", []), ("red fox", None), (None, ["red fox"])],
        "answer string, ctx array<string>",
    )
    a, c = F.col("answer"), F.col("ctx")
    got = rows.select(evaluation.sentence_precision(a, c).alias("p"), evaluation.precision(a, c).alias("q"), evaluation.faithfulness(a, c).alias("f"))
    assert [tuple(r) for r in got.collect()] == [(0.5, 0.5, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    embeds = lambda x: plan(rows.select(x)).count("md5(")
    assert embeds(evaluation.sentence_precision(a, c)) == embeds(evaluation.precision(a, c)) == 2 * embeds(evaluation.hash_embed(a))
    terms_ = lambda x: plan(rows.select(x)).count("array_except(")
    assert terms_(evaluation.faithfulness(a, c)) == 2 * terms_(evaluation.T.content_terms(a))


def test_windows_know_the_one_before_without_a_shuffle(spark):
    from quillspark.operators.documents import per_window

    docs = spark.createDataFrame([(1, "One two. Three four. Five six. Seven."), (2, ""), (None, "A b c d. E f g h.")], "doc_id long, text string")
    w = per_window(docs, 3, 0)
    assert "Exchange" not in w._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.idx, r.window, r.previous) for r in w.collect()} == {
        (1, 0, "One two. Three four.", None), (1, 1, "Five six. Seven.", "One two. Three four."), (None, 0, "A b c d.", None), (None, 1, "E f g h.", "A b c d."),
    }
