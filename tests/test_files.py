"""Sources, sinks, synchronisation and streams on temporary folders."""

import json

from pyspark.sql import functions as F

from quillspark.operators import sync
from quillspark.sources import files, sinks
from quillspark.streaming import sync as streams


def write(root, **texts):
    for name, text in texts.items():
        p = root / name.replace("__", "/").replace("_md", ".md").replace("_txt", ".txt")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_decodes_and_ignores(spark, tmp_path):
    write(tmp_path, a_md="alpha", sub__b_md="beta", drafts__c_md="no", empty_md="", bin_md=b"\xff\xfe\x00", sub__README_md="readme")
    got = {r.rel_path: r.text for r in files.scan(spark, str(tmp_path), ignore=["drafts/"]).collect()}
    assert got == {"a.md": "alpha", "sub/b.md": "beta", "sub/README.md": "readme"}
    assert {r.doc_id for r in files.corpus_documents(spark, str(tmp_path), "src").collect()} == {"src::a", "src::sub::b", "src::drafts::c"}
    assert {r.doc_id for r in files.batch_documents(spark, str(tmp_path)).collect()} == {"a"}


def test_ignore_rules(spark):
    rules = ["drafts/", "build/*", "*.log", "/top.md", "# note", ""]
    paths = ["drafts/a.md", "xdrafts/a.md", "build/x", "a/b.log", "top.md", "a/top.md", "ok.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.where(~sync.ignored(F.col("p"), rules)).collect()] == ["xdrafts/a.md", "a/top.md", "ok.md"]


def test_difference_and_state(spark):
    disk = spark.createDataFrame([("new", "1"), ("changed", "2"), ("same", "3")], "rel_path string, checksum string")
    state = spark.createDataFrame([("changed", "0"), ("same", "3"), ("gone", "4")], "rel_path string, checksum string")
    diff = sync.difference(disk, state)
    assert {r.rel_path: r.action for r in diff.collect()} == {"new": "NEW", "changed": "CHANGED", "same": "UNCHANGED", "gone": "DELETED"}
    after = sync.next_state(diff, disk.where("rel_path <> 'new'"), state)
    assert {tuple(r) for r in after.collect()} == {("changed", "2"), ("same", "3")}


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("txn_id,from,to,amount,device,card\n1,a,b,2.5,d,c\n2,a,b,bad,d,c\n")
    assert [r.amount for r in files.transactions_csv(spark, str(tmp_path / "t.csv")).collect()] == [2.5, 0.0]
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "src": "a", "dst": "b", "amount": "3"}, {"txn_id": "2", "from": "c", "to": "d"}]))
    assert [(r.txn_id, r["from"], r.amount) for r in files.transactions_json(spark, str(tmp_path / "t.json")).collect()] == [("1", "a", 3.0), ("2", "c", 0.0)]


def test_upsert_delete_and_cache(spark, tmp_path):
    p = str(tmp_path / "table")
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), p, ["id"])
    sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), p, ["id"])
    assert {tuple(r) for r in sinks.read(spark, p).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert sinks.delete(spark, p, F.col("id") == 1) == 1 and sinks.read(spark, p).count() == 2
    c = str(tmp_path / "cache")
    rows = [("q", "s", "yes", True, False), ("r", "s", "", True, False), ("x", "s", "a", True, True), ("y", "s", "", False, False)]
    sinks.store_answers(spark.createDataFrame(rows, "query string, scope string, answer string, synthesize boolean, degraded boolean"), c)
    assert {r.query for r in sinks.read(spark, c).collect()} == {"q", "y"}
    d = str(tmp_path / "dx")
    head = {"query": "q", "mode": "differential", "min_confidence": ""}
    sinks.persist_differential(spark.createDataFrame([(1, "Flu", "low")], "rank int, candidate string, confidence string"), head, d)
    sinks.persist_differential(spark.createDataFrame([(1, "Measles", "high")], "rank int, candidate string, confidence string"), head, d)
    listed = sinks.list_differentials(spark, d, 5, "q").collect()
    assert len(listed) == 1 and [x.candidate for x in listed[0].candidates] == ["Measles"]


def test_watch_is_incremental(spark, tmp_path):
    root, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(root, a_md="alpha")
    run = streams.keep_documents(out, str(root))
    streams.watch(spark, str(root), run, cp).awaitTermination()
    write(root, sub__b_md="beta")
    streams.watch(spark, str(root), run, cp).awaitTermination()
    assert {r.rel_path: r.text for r in sinks.read(spark, out).collect()} == {"a.md": "alpha", "sub/b.md": "beta"}


def test_labels_by_state(spark, tmp_path):
    src = str(tmp_path / "names")
    spark.createDataFrame([("x", "BM25")] * 3 + [("x", "Once")], "domain string, name string").coalesce(1).write.json(src)
    stream = spark.readStream.schema("domain string, name string").json(src)
    q = streams.promoted_labels(stream).writeStream.format("memory").queryName("promoted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.label, r.occurrences) for r in spark.sql("select * from promoted").collect()] == [("bm25", 3)]
