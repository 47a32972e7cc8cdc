"""Labels by state on a stream against the batch operators: threshold, cap, provenance, expiry."""

import json
import random

from quillspark.operators import labels as L
from quillspark.streaming.labels import label_history

SCHEMA = "domain string, name string, type string, seen timestamp"


def history(spark, tmp_path, batches, **how):
    """The history after one micro-batch for each list of rows, in order."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        lines = [json.dumps({"domain": d, "name": n, "type": t, "seen": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"}) for d, n, t, s in rows]
        (source / f"{i:03d}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        write = label_history(stream, **how).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)
        write.start(out).awaitTermination()
    return spark.read.parquet(out).collect()


def now(rows):
    """The last word on each label: promoted ones are active."""
    told = {}
    for r in rows:
        change = (r.seen, {"promoted": 1, "evicted": 2, "expired": 3}[r.action])
        told.setdefault((r.domain, r.label), []).append(change)
    return {k for k, v in told.items() if sum(1 if a == 1 else -1 for _, a in v) == 1}


def test_the_set_equals_the_batch_result(spark, tmp_path):
    r = random.Random(3)
    names = ["Alpha", "alpha", "Beta Two", "Gamma", "delta", "Eps", "Zeta", "Eta", "Theta", "is part of"]
    rows = [(r.choice(["d1", "d1", "d2"]), r.choice(names), None, i * 5) for i in range(90)]
    batches = [rows[:50], rows[50:70], rows[70:]]
    got = now(history(spark, tmp_path, batches, cap=3))
    flat = spark.createDataFrame([(d, n, i, s) for i, (d, n, _, s) in enumerate(rows)], "domain string, name string, doc_id long, seen long")
    want = {(x.domain, x.label) for x in L.promote(L.candidates(flat), cap=3).collect()}
    assert got == want and len(want) == 6


def test_types_keep_their_names_and_unseen_labels_expire(spark, tmp_path):
    old = [("d", "Kafka", "Queue", i) for i in range(3)] + [("d", "Rabbit", "Queue", 4 + i) for i in range(3)] + [("d", "Plain", None, 2)] * 3
    later = [("d", "Fresh", None, 1200 + i) for i in range(3)]
    rows = history(spark, tmp_path, [old, later, [("d", "Fresh", None, 2000)]], ttl_ms=600_000)
    assert {("Queue", "promoted"), ("Plain", "promoted"), ("Queue", "expired"), ("Plain", "expired"), ("Fresh", "promoted")} == {(r.label, r.action) for r in rows} - {("Fresh", "expired")}
    assert [r.names for r in rows if r.label == "Queue" and r.action == "expired"] == [["Kafka", "Rabbit"]]
