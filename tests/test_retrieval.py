"""Search, fusion, corrective retrieval, registry and labels on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.config import Profile, Profiles
from quillspark.models import Models, extractive_answer
from quillspark.operators import aliases, corrective, evaluation, fusion, labels, search, terminology, transactions
from quillspark.retrievers import Registry, ask, dense
from quillspark.sources.files import frontier, generated_transactions


def test_top_k_ties_and_empty(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, vector array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "qid int, vector array<float>")
    assert [(r.id, r.score) for r in search.top_k(q, v, 3).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert search.top_k(q.where("qid > 1"), v, 3).count() == 0


def test_match_entities(spark):
    nodes = spark.createDataFrame([("n1", [1.0, 0.0])], "id string, vector array<float>")
    names = spark.createDataFrame([("Kafka", "T", [0.99, 0.05]), ("New", "T", [0.0, 1.0])], "name string, type string, vector array<float>")
    got = {r.name: (r.id, r.matched) for r in search.match_entities(names, nodes).collect()}
    assert got["Kafka"] == ("n1", True) and got["New"][0] != "n1" and not got["New"][1]


def test_hybrid_scores_is_an_extension(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.3)], "qid int, id int, score double")
    s = spark.createDataFrame([(1, 2, 5.0)], "qid int, id int, score double")
    assert [r.id for r in search.hybrid_scores(d, s, 2).orderBy("rank").collect()] == [2, 1]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, "[DIAGNOSIS CANDIDATE] Measles (SNOMED 9)", "d1", "9"), (1, 2, "[DIAGNOSIS CANDIDATE] Flu (SNOMED 8)", "d2", "8")], "qid int, arrival int, text string, doc_id string, concept_id string").withColumn("signal", F.lit("g"))
    b = spark.createDataFrame([(1, 1, "[CLINICAL PROSE] Measles\nx", "p1"), (1, 2, "[CLINICAL PROSE] Measles\nx", "p1")], "qid int, arrival int, text string, doc_id string").withColumn("signal", F.lit("p"))
    pool = fusion.dual_flags(fusion.dedupe(fusion.union_signals(a, b)))
    assert {r.doc_id: r.dual for r in pool.collect()} == {"d1": True, "d2": False, "p1": True}
    assert {r.doc_id for r in fusion.only_dual(pool).collect()} == {"d1", "p1"}
    rows = fusion.ranked(pool, 5)
    assert [r.doc_id for r in rows.orderBy("rank").collect()] == ["d1", "p1", "d2"]
    assert fusion.floor(rows, "high").count() == 3  # none reaches it: all stay


def test_corrective(spark):
    q = spark.createDataFrame([(1, "who reported BUG-204?"), (2, "why did checkout fail badly today")], "qid int, text string")
    got = lambda texts: lambda queries: queries.select("qid", F.lit(1).alias("rank"), F.lit(texts).alias("text"))
    out = {r.qid: r for r in corrective.corrective(q, got("frank reported bug 204"), got("checkout failed today. The cause was checkout."), extractive_answer).collect()}
    assert out[1].path == "graph" and out[1].grade == "CORRECT" and out[1].rewritten is None
    assert out[2].path == "hybrid" and out[2].contexts == ["checkout failed today. The cause was checkout."]
    assert spark.range(1).select(corrective.grade(F.lit("a question"), F.array().cast("array<string>")).alias("g")).first().g == "INCORRECT"


def test_aliases(spark):
    e = spark.createDataFrame([("Non-Disclosure Agreement", "LegalDoc", ["NDA", "confidentiality agreement"], 1), ("Hypertension", "Disease", ["htn"], 2)], "name string, type string, aliases array<string>, ord int")
    q = spark.createDataFrame([(1, "sign the nda and the confidentiality agreement"), (2, "HTN or handa"), (3, "nothing")], "qid int, text string")
    got = {r.qid: r.expanded for r in aliases.expand_queries(q, aliases.alias_map(e)).collect()}
    assert got[1].endswith(" (Non-Disclosure Agreement)") and got[2] == "HTN or handa (Hypertension)" and got[3] == "nothing"


def test_terminology(spark):
    concepts = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "id int, active int")
    d = spark.createDataFrame([(1, "fever", "en", 2), (2, "rash", "en", 1), (3, "Measles", "en", 1), (3, "Masern", "de", 3), (4, "fever", "en", 1)], "concept_id int, term string, language_code string, type_id int")
    edges = spark.createDataFrame([(3, 1, "REL_47429007"), (3, 2, "REL_47429007"), (2, 1, "OTHER")], "src int, dst int, rel string")
    q = spark.createDataFrame([(1, "fever and rash; or")], "qid int, text string")
    got = terminology.by_symptoms(q, concepts, d, edges).orderBy("rank").collect()
    assert (got[0].id, got[0].name, got[0].edges) == (3, "Measles", 2)
    text = terminology.candidate_text(terminology.by_symptoms(q, concepts, d, edges)).where("id = 3").first().text
    assert text.startswith("[DIAGNOSIS CANDIDATE] Measles (SNOMED 3)\n  Matched terms: (edge match only)")
    days = spark.createDataFrame([(1, '{"day2": ["rash"], "day1": ["fever"]}')], "qid int, text string")
    assert {r.id for r in terminology.by_presentation(days, concepts, d).collect()} == {1, 2}


def test_transactions(spark):
    t = generated_transactions(spark)
    q = spark.createDataFrame([(1, "is account alpha ok"), (2, "account rapid"), (3, "acct nobody")], "qid int, text string")
    got = transactions.signals(q, t).collect()
    assert {r.doc_id for r in got if r.qid == 1} == {"fraud:alpha:beta", "fraud:alpha:gamma"}
    assert [r.doc_id for r in got if r.qid == 2] == ["fraud:velocity:rapid"] and not [r for r in got if r.qid == 3]


def test_registry_and_ask(spark):
    docs = Profile("docs", "docs", companions=("prose",), entity_types=("T",), relation_types=("R",), top_k=2)
    prose = Profile("prose", "prose", retrieval="dense_prose", top_k=2)
    profiles = Profiles([docs, prose], {"d": "docs"}, "docs")
    assert profiles.get("D").name == "docs" and profiles.get("nope").name == "docs" and not profiles.known("nope")
    with pytest.raises(ValueError):
        Profile("bad", "bad")
    m = Models()
    chunks = spark.createDataFrame([(1, "kafka stores logs", "a"), (2, "cats sleep", "b"), (3, "kafka queues", "c")], "id int, text string, doc_id string")
    chunks = chunks.withColumn("doc_type", F.lit("chunk")).withColumn("vector", m.embed(F.col("text")))
    r = Registry(profiles, lambda p: dense(chunks, m.embed, "[P] " if p.name == "prose" else ""))
    q = spark.createDataFrame([(1, "what are kafka logs")], "qid int, text string")
    rows, answers = ask(r, "d", q, 3, m)
    assert rows.orderBy("rank").first().doc_id == "a" and "kafka stores logs" in answers.first().answer
    assert (answers.first().failed, answers.first().degraded) == ([], False)

    def broken(message):
        def build(p):
            def retrieve(queries, k):
                raise RuntimeError(message)

            return retrieve if p.name == "prose" else dense(chunks, m.embed)

        return Registry(profiles, build)

    _, answers = ask(broken("no such host"), "d", q, 3, m)
    assert (answers.first().failed, answers.first().degraded) == (["prose"], True)
    with pytest.raises(RuntimeError, match="No space left"):
        ask(broken("No space left on device"), "d", q, 3, m)


def test_labels_and_frontier(spark):
    d = spark.createDataFrame([("x", "BM25", 1, i) for i in range(4)] + [("x", "uses it", 1, i) for i in range(9)] + [("x", "Rare", 1, 9)], "domain string, name string, doc_id int, seen int")
    assert [r.label for r in labels.promote(labels.candidates(d)).collect()] == ["BM25"]
    pages = spark.createDataFrame([(t, "x" * 300) for t in "abc"] + [("d", "short")], "title string, text string")
    links = spark.createDataFrame([("a", "b", 0), ("a", "d", 1), ("b", "c", 0), ("b", "a", 1)], "title string, target string, pos int")
    seeds = spark.createDataFrame([("a", 0)], "title string, ord int")
    assert [(r.title, r.depth) for r in frontier(seeds, links, pages, 3).orderBy("ord").collect()] == [("a", 0), ("b", 1), ("d", 1)]
    assert frontier(seeds, links, pages, 10).count() == 4


def test_metrics_of_answers(spark):
    f = lambda a, c: spark.range(1).select(evaluation.faithfulness(F.lit(a), F.array(*map(F.lit, c))).alias("x")).first().x
    assert f("Kafka stores logs. Cats sleep.", ["kafka stores logs"]) == 0.5
    assert f("The context does not mention it.", ["x"]) == 1.0 and f("", ["x"]) == 0.0
    r = spark.range(1).select(evaluation.recall(F.lit("384 was 250 before v1.0.7"), F.array(F.lit("it was 384, 250 before"))).alias("x")).first().x
    assert r > 0.5


def test_blocks_of_queries_give_what_one_gives(spark, monkeypatch):
    import random

    from quillspark.operators import search

    r = random.Random(1)
    v = spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(8)], i % 3) for i in range(200)], "id long, vector array<double>, label int")
    q = v.where("id % 9 = 0").select(F.col("id").alias("qid"), "vector")
    one = [sorted(search.top_k(q, v, 4, per, floor).collect()) for per, floor in (([], None), (["label"], 0.2))]
    monkeypatch.setattr(search, "BLOCK_VALUES", 40)
    assert [sorted(search.top_k(q, v, 4, per, floor).collect()) for per, floor in (([], None), (["label"], 0.2))] == one and len(one[0]) == 23 * 4


def test_a_model_is_built_once_a_worker_and_fed_in_batches(spark, tmp_path):
    from quillspark.models import by_batches
    from quillspark.shipping import ship

    ship(spark)
    log = str(tmp_path)

    def build():
        import os
        import uuid

        open(os.path.join(log, f"built-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def model(texts):
            open(os.path.join(log, f"batch-{len(texts)}-{uuid.uuid4().hex}"), "w").close()
            return [[float(len(t)), 1.0] for t in texts]

        return model

    embed = by_batches(f"lengths {log}", build, "array<double>")
    rows = spark.range(0, 1000, 1, 8).select("id", F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("t"))
    for _ in range(3):
        assert all(r.v == [float(len(r.t or "")), 1.0] for r in rows.withColumn("v", embed(F.col("t"))).collect())
    made = os.listdir(log)
    built = [x.split("-")[1] for x in made if x.startswith("built")]
    assert len(built) == len(set(built)) <= 8 and max(int(x.split("-")[1]) for x in made if x.startswith("batch")) <= 64


def test_aliases_come_before_retrieval(spark):
    from quillspark.retrievers import with_aliases

    m = Models()
    chunks = spark.createDataFrame([(1, "apache kafka stores logs", "a"), (2, "cats sleep on the bus", "b")], "id int, text string, doc_id string")
    chunks = chunks.withColumn("doc_type", F.lit("chunk")).withColumn("vector", m.embed(F.col("text")))
    aliases = spark.createDataFrame([("the bus", "Apache Kafka")], "alias string, canonical string")
    q = spark.createDataFrame([(1, "what does the bus do")], "qid int, text string")
    plain, aliased = dense(chunks, m.embed, ""), with_aliases(dense(chunks, m.embed, ""), aliases)
    score = lambda r: {x.doc_id: x.arrival for x in r(q, 2).collect()}
    assert score(plain)["b"] < score(plain)["a"] and set(score(aliased)) == {"a", "b"}
    seen = []
    with_aliases(lambda queries, k: seen.append(queries.first().text) or queries, aliases)(q, 1)
    assert seen == ["what does the bus do (Apache Kafka)"]
