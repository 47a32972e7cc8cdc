"""Sinks, sources and small operators that no query of the catalogue runs."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark import config
from quillspark.config import Profile, Profiles
from quillspark.functions import text as T
from quillspark.functions.vectors import hash_embed
from quillspark.models import Models
from quillspark.operators import documents, evaluation, extraction, fusion, labels, matching, metrics, ranking, search
from quillspark.operators import graph as G
from quillspark.retrievers import Registry, across, default, dense, federated
from quillspark.sources import files, sinks
from quillspark.streaming import sync as streams


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.replace(spark.range(3), p)
    boom = F.udf(lambda x: 1 / 0, "double")
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        sinks.replace(spark.range(2).select(boom("id").alias("id")), p)
    assert sinks.read(spark, p).count() == 3
    before = sinks.read(spark, p)
    sinks.replace(spark.range(5), p)
    assert before.count() == 3 and sinks.read(spark, p).count() == 5  # a reader keeps its version
    for n in (6, 7):
        sinks.replace(spark.range(n), p)
    assert len(list((tmp_path / "t").glob("v-*"))) == 2 and not list((tmp_path / "t").glob("*.pointer"))
    with pytest.raises(FileNotFoundError):
        sinks.read(spark, str(tmp_path / "none"))


def test_delete_ingest_counts_and_misses(spark, tmp_path):
    chunks, nodes, edges = (str(tmp_path / x) for x in ("chunks", "nodes", "edges"))
    sinks.replace(spark.createDataFrame([("d1", 0), ("d1", 1), ("d2", 0)], "doc_id string, chunk_idx int"), chunks)
    sinks.replace(spark.createDataFrame([("x", ["d1", "d2"]), ("y", ["d1"])], "id string, source_docs array<string>"), nodes)
    sinks.replace(spark.createDataFrame([("x", "y", "R", ["d1"])], "src string, dst string, rel string, source_docs array<string>"), edges)
    assert sinks.delete_ingest(spark, "d1", chunks, nodes, edges) == {"vectors": 2, "nodes": 2}
    assert [r.id for r in sinks.read(spark, nodes).collect()] == ["x"] and sinks.read(spark, edges).count() == 0
    with pytest.raises(KeyError):
        sinks.delete_ingest(spark, "d1", chunks, nodes, edges)
    assert sinks.read(spark, chunks).count() == 1


def test_differentials_are_deleted_by_query_mode_and_floor(spark, tmp_path):
    d = str(tmp_path / "dx")
    rows = spark.createDataFrame([(1, "Flu", "low")], "rank int, candidate string, confidence string")
    for floor in ("", "high"):
        sinks.persist_differential(rows, {"query": "q", "mode": "differential", "min_confidence": floor}, d)
    assert sinks.delete_differential(spark, d, "other") == 0
    assert sinks.delete_differential(spark, d, "q") == 1 and sinks.delete_differential(spark, d, "q") == 0
    assert [r.min_confidence for r in sinks.list_differentials(spark, d, 5).collect()] == ["high"]


def test_log_and_reembedding(spark, tmp_path):
    log = str(tmp_path / "log")
    for i in range(2):
        sinks.append_log(spark.createDataFrame([(i, "x")], "n int, what string"), log)
    assert sorted(r.n for r in spark.read.json(log).collect()) == [0, 1]
    c = spark.createDataFrame([(1, "a b", [0.0], "s")], "id int, text string, vector array<float>, sparse string")
    r = sinks.reembed(c, lambda t: hash_embed(t, 8)).first()
    assert sum(r.vector) == 2 and r.sparse == "s" and len(r.vector) == 8


def test_pdf_and_golden_rows(spark, tmp_path):
    f = spark.createDataFrame([("a.pdf", bytearray(b"%PDF hello")), ("b.pdf", None)], "path string, content binary")
    assert {r.path: r.text for r in files.pdf_text(f, lambda b: b.decode()[5:]).collect()} == {"a.pdf": "hello", "b.pdf": None}
    (tmp_path / "g.json").write_text(json.dumps([{"question": "q", "ground_truth": "t", "contexts": ["c"], "doc_id": "d"}, {"question": "r"}]))
    got = {r.question: r for r in files.golden(spark, str(tmp_path / "g.json")).collect()}
    assert got["q"].contexts == ["c"] and got["r"].ground_truth is None


def test_chunks_names_and_ranks(spark):
    pieces = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 0, "w"), ("b", 1, "z")], "doc_id string, chunk_idx int, text string")
    assert [(r.doc_id, r.text) for r in documents.first_chunks(pieces).collect()] == [("a", "w")]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.graph_label(F.lit("Clinical note"))) == "Clinical_note" and one(T.graph_label(F.lit("9x"))) is None
    assert one(T.display_name(F.lit("[DIAGNOSIS CANDIDATE] Flu (SNOMED 8)\nmore"))) == "Flu"
    rows = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "n int, v string")
    assert [r["rank"] for r in ranking.global_rank(rows, ["n"], "rank").orderBy("n").collect()] == list(range(1, 51))
    values = spark.createDataFrame([("a", float(v)) for v in range(1, 40)] + [("b", 5.0), ("b", 7.0)], "g string, v double")
    got = {r.g: r.quantile for r in metrics.exclusive(values, "g", "v").collect()}
    assert got == {"a": 38.0, "b": 8.7}


def test_fallback_types_and_whole_documents(spark):
    dropped = spark.createDataFrame([("d", "Kafka"), ("d", "uses")], "doc_id string, name string")
    typed = extraction.fallback_types(dropped, lambda n: F.when(n == "Kafka", "Service").otherwise("Verb"), ["Service"])
    assert [(r.name, r.type, r.discovered_by) for r in typed.collect()] == [("Kafka", "Service", "llm_fallback")]
    answer = '```json\n{"nodes": [{"name": "A", "type": "T"}], "edges": [{"from": "A", "to": "B", "type": "USES"}]}\n```'
    nodes, edges = extraction.whole_document(spark.createDataFrame([("d", answer)], "doc_id string, a string"), F.col("a"))
    assert [(r.doc_id, r.id) for r in nodes.collect()] == [("d", "A")]
    assert [(r.source, r.target, r.type) for r in edges.collect()] == [("A", "B", "USES")]


def test_contains_join_is_every_pair(spark):
    words = ["a", "ab", "abc", "bcd", "hello world and", "é", "", None, "zz", "ABC"]
    texts = ["abcde", "xabc hello world and more", "é", "", None, "ABab", "aaaa"]
    n = spark.createDataFrame([(w,) for w in words], "needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "i int, hay string")
    got = {(r.needle, r.i) for r in matching.containing(n, t, "needle", "hay").collect()}
    assert got == {(w, i) for w in words if w for i, x in enumerate(texts) if x and w in x}


def test_entries_by_substring_and_vector(spark):
    nodes = spark.createDataFrame([("svc-1", "checkout service"), ("svc-2", "billing"), ("n3", None)], "id string, name string")
    q = spark.createDataFrame([(1, "check the bill"), (2, "billing service"), (3, "zzz")], "qid int, text string")
    assert {(r.qid, r.id) for r in G.substring_candidates(q, nodes).collect()} == {(1, "svc-2"), (2, "svc-1"), (2, "svc-2")} | {
        (1, i) for i, s in (("svc-1", "checkout service"),) if any(w in s for w in ("check", "the", "bill"))
    }
    got = {r.qid: r.id for r in G.entry_by_vector(q, nodes).collect()}
    assert got[2] in ("svc-1", "svc-2") and set(got) == {1, 2, 3}
    edges = spark.createDataFrame([("svc-1", "svc-2", "USES")], "src string, dst string, rel string")
    for strategy in ("keyword", "vector", "hybrid"):
        kept, _ = G.subgraph(q.where("qid = 2"), nodes, edges, 1, strategy=strategy)
        assert {r.id for r in kept.collect()} == {"svc-1", "svc-2"}
    resolved = G.resolve_edges(spark.createDataFrame([("a", "b", "R"), ("a", "zz", "R")], "source string, target string, rel string"), spark.createDataFrame([("a", 1), ("b", 2)], "name string, id int"))
    assert [(r.src, r.dst, r.rel) for r in resolved.collect()] == [(1, 2, "R")]


def test_sources_that_fail_and_all_domains(spark):
    m = Models()
    kinds = {"entity_types": ("T",), "relation_types": ("R",)}
    profiles = Profiles([Profile("one", "a", companions=("bad",), top_k=1, **kinds), Profile("bad", "b", **kinds), Profile("two", "c", top_k=2, **kinds)], {}, "one")
    chunks = spark.createDataFrame([(1, "kafka logs", "d1", "Kafka"), (2, "cats", "d2", "Cats")], "id int, text string, doc_id string, title string")
    chunks = chunks.withColumn("doc_type", F.lit("chunk")).withColumn("vector", m.embed(F.col("text")))
    nodes = spark.createDataFrame([("k", "kafka logs"), ("z", "zoo")], "id string, name string")
    edges = spark.createDataFrame([("k", "z", "FEEDS")], "src string, dst string, rel string")

    def build(p):
        if p.name == "bad":
            return lambda q, k: q.select("nothing")
        return default(p.name, chunks, nodes, edges, m.embed)

    r = Registry(profiles, build)
    q = spark.createDataFrame([(1, "kafka logs")], "qid int, text string")
    rows, failed = federated(r, "one", q)
    assert failed == ["bad"] and {(x.signal, x.text) for x in rows.collect()} == {("one", "Kafka\nkafka logs"), ("one:graph", "GRAPH EDGE: kafka logs -[FEEDS]-> zoo")}
    assert {x.domain for x in across(r, q, ["one", "two"]).collect()} == {"one", "two"}
    none, failed = federated(r, "bad", q)
    assert failed == ["bad"] and none.count() == 0 and set(fusion.RECORD) <= set(none.columns)
    assert dense(chunks, m.embed, "[P] ")(q, 1).first().text == "[P] Kafka\nkafka logs"


def test_metrics_and_gates(spark):
    rows = spark.createDataFrame([("what is kafka", "Kafka stores many logs.", "Kafka stores many logs.", ["Kafka stores many logs. Cats sleep."])], "question string, ground_truth string, answer string, contexts array<string>")
    got = evaluation.report(evaluation.four_metrics(rows), *evaluation.FOUR).first()
    assert (got.faithfulness, got.context_precision, got.context_recall, got.n_samples) == (1.0, 1.0, 1.0, 1)
    measured = spark.createDataFrame([(0.9, 0.4, 1200.0)], "faithfulness double, context_precision double, retrieval_p95_ms double")
    assert {r.gate: r.passed for r in evaluation.gates(measured).collect()} == {"faithfulness": True, "context_precision": False, "retrieval_p95_ms": False}


def test_term_search_is_a_plain_sum(spark):
    docs = spark.createDataFrame([(1, 0, "a b b"), (1, 1, "c"), (2, 0, "b c"), (3, 0, None), (4, 0, "x")], "doc_id int, chunk_idx long, text string")
    q = spark.createDataFrame([(7, "b b c"), (8, "nothing"), (9, "x")], "qid int, text string")
    got = {(r.qid, r.doc_id, r.chunk_idx): r.score for r in search.term_top_k(q, docs, 2, 4).collect()}
    ln = 0.693147
    assert got == {(7, 1, 0): round(2 * ln, 6), (7, 2, 0): round(2 * ln, 6), (9, 4, 0): 1.386294}


def test_label_state_and_eviction(spark):
    d = spark.createDataFrame([("x", "BM25", 1, i) for i in range(4)] + [("x", "Rare", 1, 9)], "domain string, name string, doc_id int, seen int")
    found = labels.candidates(d)
    state = {r.key: (r.occurrences, r.active) for r in labels.state(found, labels.promote(found)).collect()}
    assert state == {"bm25": (4, True), "rare": (1, False)}
    assert {r.key for r in labels.evict(found, 10, 5).collect()} == {"rare"}


def test_state_forgets_names_after_their_time():
    class State:
        exists, hasTimedOut, value, timeout, removed = False, False, None, None, False  # noqa: N815 - Spark's own name

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.value, self.exists = v, True

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.timeout = ms

        def remove(self):
            self.exists, self.removed = False, True

    count, s = streams.counted_label(3, 1000), State()
    batch = lambda n: iter([pd.DataFrame({"domain": ["x"] * n, "label": ["a"] * n})])
    assert not list(count(("x", "a"), batch(2), s)) and s.timeout == 1000
    s.hasTimedOut = True
    assert not list(count(("x", "a"), iter([]), s)) and s.removed
    s.hasTimedOut = False
    assert not list(count(("x", "a"), batch(2), s)) and [f.occurrences[0] for f in count(("x", "a"), batch(1), s)] == [3]


def test_profiles_from_files(spark, tmp_path):
    given = {
        "default_domain": "Notes",
        "domains": {
            "notes": {"collection": "notes", "neo4j_label": "Note", "retrieval": "dense_prose", "top_k": 12, "entry_strategy": "vector", "chunking": {"strategy": "fixed", "chunk_size": 256, "overlap": 8}, "metadata_schema": {"fields": ["title"]}},
            "codes": {"collection": None, "retrieval": "terms", "companions": ["notes"], "entity_types": ["A", "B"], "relation_types": ["R"]},
            "N": {"alias": "Notes"}, "icd": {"alias": "codes"},
        },
    }
    (tmp_path / "p.json").write_text(json.dumps(given))
    got = config.load_profiles(spark, str(tmp_path / "p.json"))
    notes = got.get("n")
    assert (notes.name, notes.graph_label, notes.top_k, notes.entry_strategy, notes.chunking, notes.metadata_fields) == ("notes", "Note", 12, "vector", config.Chunking("fixed", 256, 8), ("title",))
    assert got.get("ICD").companions == ("notes",) and got.get("other").name == "notes" and got.names() == ["codes", "notes"]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(given))
    assert config.load_profiles(spark, str(tmp_path / "p.yaml")).get("codes") == got.get("codes")
    for bad in ({}, {"domains": {"x": {"entry_strategy": "guess"}}}, {"domains": {"x": {}, "a": {"alias": "nothing"}}}):
        with pytest.raises(ValueError):
            config.profiles_of(bad)


def test_an_unparsable_answer_falls_back_to_sentences(spark):
    docs = spark.createDataFrame([("d", "Kafka feeds Spark. Redis rests.", "sorry"), ("e", "Kafka", '{"nodes": [{"name": "A", "type": "T"}], "edges": []}')], "doc_id string, text string, a string")
    recognise = lambda t: F.transform(F.regexp_extract_all(t, F.lit("[A-Z][a-z]+"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit("Tool").alias("label")))
    nodes, edges = extraction.whole_document(docs, F.col("a"), recognise)
    assert {(r.doc_id, r.id, r.type) for r in nodes.collect()} == {("d", "Kafka", "Tool"), ("d", "Spark", "Tool"), ("d", "Redis", "Tool"), ("e", "A", "T")}
    assert [(r.doc_id, r.source, r.target, r.type) for r in edges.collect()] == [("d", "Kafka", "Spark", "ASSOCIATED_WITH")]


def test_hybrid_extraction_keeps_types_and_asks_again(spark):
    from quillspark.models import Models

    text = "Kafka feeds Spark here. " * 3
    docs = spark.createDataFrame([("d", text), ("e", "nothing"), ("n", None)], "doc_id string, text string")
    labels = {"Kafka": "Queue", "Spark": "Engine"}
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    m = Models(recognise=lambda t: F.transform(F.regexp_extract_all(t, F.lit("Kafka|Spark"), F.lit(0)), lambda x: F.struct(x.alias("text"), label[x].alias("label"))))
    one, two = '{"source": "Kafka", "target": "Flink", "type": "FEEDS"}', '{"source": "Kafka", "target": "Spark", "type": "FEEDS"}'
    ghost = '{"source": "Ghost", "target": "Spark", "type": "FEEDS"}'
    ask = lambda p: F.when(F.contains(p, F.lit("Flink")), F.lit(f"[{one}, {two}]")).when(F.contains(p, F.lit("Kafka")), F.lit(f"[{one}, {ghost}]")).otherwise("[]")
    classify = lambda n: F.when(n == "Flink", "Engine").otherwise("Spirit")
    out = extraction.hybrid(docs, m, ask, ["FEEDS"], classify, ["Engine", "Queue"])
    assert {(r.name, r.type, r.discovered_by) for r in out.nodes.collect()} == {("Kafka", "Queue", None), ("Spark", "Engine", None), ("Flink", "Engine", "llm_fallback")}
    assert sorted((r.source_name, r.target_name) for r in out.edges.collect()) == [("Kafka", "Flink"), ("Kafka", "Spark")]
    assert {(r.name, r.inferred_type, r.method) for r in out.audit.collect()} == {("Flink", "Engine", "llm_fallback"), ("Ghost", None, "dropped")}
    once = extraction.hybrid(docs, m, ask, ["FEEDS"])
    assert once.edges.count() == 0 and {(r.name, r.method) for r in once.audit.collect()} == {("Flink", "dropped"), ("Ghost", "dropped")}
    found, _ = extraction.by_windows(docs, m, ask, ["FEEDS"])
    assert {(r.name, r.label) for r in found.collect()} == {("Kafka", "Queue"), ("Spark", "Engine")}


def test_slices_of_words_merge_by_name_and_type(spark):
    text = " ".join(["x"] * 511 + ["Kafka", "kafka", "Spark"])
    docs = spark.createDataFrame([("d", text), ("e", " \n "), ("n", None)], "doc_id string, text string")
    recognise = lambda t: F.transform(F.regexp_extract_all(t, F.lit("(?i)kafka|spark"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.when(F.size(F.split(t, " ")) > 100, "Big").otherwise("Small").alias("label")))
    got = [(r.name, r.label) for r in extraction.entities_in_slices(docs, recognise).orderBy("ord").collect()]
    assert got == [("Kafka", "Big"), ("kafka", "Small"), ("Spark", "Small")]
