"""Model output: scanners, relation lists and the canonical graph schema."""

from pyspark.sql import functions as F

from quillspark.functions import parsing as P
from quillspark.operators import extraction as X


def test_first_object():
    assert P.first_object('say {"a": "}{", "b": {"c": 1}} and {"d": 2}') == '{"a": "}{", "b": {"c": 1}}'
    assert P.first_object("none") is None and P.first_object('{"cut": 1') is None and P.first_object(None) is None
    assert P.first_object("{not json}") is None


def test_salvage_opens_wrappers_and_drops_what_is_cut_off():
    text = '[{"source": "a", "target": "b"}, {"relations": [{"source": "c", "target": "d"}, {"x": 1}]}, {"source": "e", "tar'
    assert [(r["source"], r["target"]) for r in P.all_objects(text)] == [("a", "b"), ("c", "d")]


def test_relation_lists():
    r = '{"source": "a", "target": "b", "type": "R"}'
    for text in (f"```json\n[{r}]\n```", f"thinking {{x}} so [{r}]", f'<|channel|>old [1]<|channel|>{{"relations": [{r}]}}'):
        found = P.relation_list(text)
        assert found and found[-1].get("source", "a") == "a", text
    assert P.relation_list(f"x {r}") == []  # one bare object is no list
    assert P.relation_list("nothing here") is None
    assert P.reasoned_relations("thus -> rover FOUND ICE-7")[0] == {"source": "rover", "type": "FOUND", "target": "ICE-7"}


def test_validated_relations(spark):
    answers = spark.createDataFrame(
        [
            (1, 0, '[{"source": "Kafka.", "target": "CPU", "type": "USES", "confidence": "bad"}, {"source": "kafka", "target": "CPU", "type": "USES"}]'),
            (1, 1, '[{"source": "Kafka", "target": "CPU", "type": "USES"}, {"source": "Kafka", "target": "CPU", "type": "HATES"}]'),
            (2, 0, None),
        ],
        "doc_id int, idx int, answer string",
    )
    names = spark.createDataFrame([(1, "Kafka"), (1, "CPU")], "doc_id int, name string")
    kept, dropped = X.relations(answers, names, ["USES"])
    assert [tuple(r) for r in kept.collect()] == [(1, "Kafka", "CPU", "USES", 1.0)]
    assert [tuple(r) for r in dropped.collect()] == [(1, "kafka")]


def test_normal_graph(spark):
    text = '{"nodes": [{"name": "A", "entity_type": "T"}, {"id": "", "label": "B"}, {"type": "x"}], "edges": [{"head": "A", "tail": "B"}, {"from": "A"}, {"subject": "A", "object": "B", "relation": "R"}]}'
    row = spark.range(1).select(P.normal_nodes(F.lit(text)).alias("n"), P.normal_edges(F.lit(text)).alias("e")).first()
    assert [(x["id"], x["type"]) for x in row.n] == [("A", "T"), ("B", "Unknown")]
    assert [(x["source"], x["target"], x["type"]) for x in row.e] == [("A", "B", "RELATED"), ("A", "B", "R")]
    empty = spark.range(1).select(P.normal_nodes(F.lit(None).cast("string")).alias("n")).first()
    assert empty.n == []


def test_scanning_cut_off_text_is_linear():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert P.all_objects('{"a": ' * n + '{"source": "x", "target": "y"} and {"source": "cut') == [{"source": "x", "target": "y"}]
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 5
    assert P.all_objects('}} {"relations": [{"source": 1, "target": 2}]} {bad} {{"source": "a", "target": "b"}') == [{"source": 1, "target": 2}, {"source": "a", "target": "b"}]


def test_whole_objects_stay_in_the_jvm(spark):
    texts = [' {"a": {"b": 1}} ', 'so: {"c": "}"} done', "{broken", '{"a": 1} {"b": 2}', None, "", "[1]", '{"d": "x}"}', '{"a": 1}, {"b": 2}', "{'a': 1}", '{"a": 1,}', '{"a": 1} x}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.o for r in P.with_json_object(df, "t", "o").collect()}
    assert got == {i: (P.first_object(t) if t else None) for i, t in enumerate(texts)}
    plan = P.with_json_object(df, "t", "o")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" in plan.split("ArrowEvalPython")[0]  # one branch has no Python


def test_sketches_merge_within_their_bound(spark):
    from quillspark.operators import metrics as M

    rows = spark.range(60_000).selectExpr("cast(id % 3 as int) g", "cast(id % 24 as int) h", "cast((id * 7919) % 60000 as double) v")
    kept = M.merged_sketches(M.sketches(rows, ["g", "h"], "v", 100), ["g"])
    got = M.sketched_quantiles(kept, 0.1, 0.5, 0.99).collect()
    exact = {r.g: sorted(x.v for x in rows.where(f"g = {r.g}").collect()) for r in kept.collect()}
    assert len(got) == 9 and all(abs(sum(v <= r.q for v in exact[r.g]) / r.n - r.p) <= M.sketch_error(100) for r in got)
    assert max(len(r.sketch) for r in kept.collect()) < 8000 and M.sketches(rows.limit(0), ["g"], "v").count() == 0
