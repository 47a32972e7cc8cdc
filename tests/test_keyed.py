"""Tables by key: what a batch touches, what stays; deletions in a watched folder; writers that meet."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.sources import keyed, sinks
from quillspark.streaming.sync import synchronise, watch_folder


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.upsert(spark.range(200).select("id", F.lit("old").alias("v")), path, ["id"], parts=16)
    before = files(path)
    assert keyed.upsert(spark.createDataFrame([(7, "new"), (7, "new"), (999, "more")], "id long, v string"), path, ["id"], parts=16) <= 2
    kept = before & files(path)
    assert len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in kept}) <= 2
    got = dict(rows(keyed.read(spark, path)))
    assert len(got) == 201 and got[7] == "new" and got[999] == "more" and got[8] == "old"
    assert keyed.delete(spark.createDataFrame([(7,), (12345,)], "id long"), path, ["id"], parts=16) == 1
    assert kept & files(path) == kept - {f for f in kept if f not in files(path)} and keyed.read(spark, path).count() == 200
    assert keyed.delete(spark.createDataFrame([(54321,)], "id long"), path, ["id"], parts=16) == 0


def test_nulls_repeats_new_columns_and_emptied_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(None, "a", 1), (None, "b", 2), (1, "c", 5), (1, "d", 4)], "id long, v string, at int")
    keyed.upsert(batch, path, ["id"], parts=4, order="at")
    assert rows(keyed.read(spark, path)) == [(1, "c", 5), (None, "b", 2)]
    keyed.upsert(spark.createDataFrame([(None, "z", True)], "id long, v string, extra boolean"), path, ["id"], parts=4)
    assert {(r.id, r.v, r.at, r.extra) for r in keyed.read(spark, path).collect()} == {(1, "c", 5, None), (None, "z", None, True)}
    keyed.delete(spark.createDataFrame([(None,)], "id long"), path, ["id"], parts=4)
    assert keyed.read(spark, path).count() == 1 and len(os.listdir(path)) <= 4
    assert keyed.upsert(batch.limit(0), path, ["id"], parts=4) == 0 and keyed.delete(batch, str(tmp_path / "none"), ["id"]) == 0


def test_upsert_is_by_id_and_delete_keeps_the_layout(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id long, k string"), path, ["id"], ["k"])
    sinks.upsert(spark.createDataFrame([(None, "c"), (2, "a")], "id long, k string"), path, ["id"])
    assert rows(sinks.read(spark, path).select("id", "k")) == [(1, "a"), (2, "a"), (None, "c")]
    assert sinks.delete(spark, path, F.col("id") == 2) == 1
    current = os.path.join(path, sinks._current(spark, path)[0])
    assert sorted(x for x in os.listdir(current) if "=" in x) == ["k=a", "k=c"] and sinks.layout(spark, path) == ["k"]


def test_of_two_writers_of_one_version_the_second_is_told(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1,)], "id long")
    sinks.replace(df, path)
    seen = sinks._current(spark, path)[0]
    sinks.upsert(spark.createDataFrame([(2,)], "id long"), path, ["id"])
    with pytest.raises(sinks.Conflict):
        sinks.replace(df, path, made_from=seen)
    assert rows(sinks.read(spark, path)) == [(1,), (2,)]
    with sinks.locked(spark, path), pytest.raises(sinks.Conflict):
        sinks.upsert(df, path, ["id"])
    sinks.upsert(df, path, ["id"])  # the lock is gone
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) <= 3


def test_a_folder_with_added_changed_touched_and_deleted_files(spark, tmp_path):
    root, path = tmp_path / "docs", str(tmp_path / "t")
    (root / "sub").mkdir(parents=True)
    for i in range(30):
        (root / ("sub" if i % 2 else ".") / f"f{i}.md").write_text(f"text {i}")
    (root / "empty.md").write_text("")
    assert synchronise(spark, str(root), path, 16) == {"new": 30, "changed": 0, "unchanged": 0, "deleted": 0}
    before = files(path)
    assert synchronise(spark, str(root), path, 16) == {"new": 0, "changed": 0, "unchanged": 30, "deleted": 0} and files(path) == before
    (root / "f0.md").write_text("text changed")
    (root / "sub/f1.md").unlink()
    (root / "added.md").write_text("added")
    os.utime(root / "f2.md", (1, 1))
    assert synchronise(spark, str(root), path, 16) == {"new": 1, "changed": 1, "unchanged": 28, "deleted": 1}
    got = {r.rel_path: r.text for r in keyed.read(spark, path).collect()}
    assert len(got) == 30 and got["f0.md"] == "text changed" and got["added.md"] == "added" and "sub/f1.md" not in got and got["f2.md"] == "text 2"
    assert len(before & files(path)) >= len(before) // 2  # the others keep their files


def test_the_watch_sees_deletions(spark, tmp_path):
    root, path, told = tmp_path / "docs", str(tmp_path / "t"), []
    root.mkdir()
    (root / "a.md").write_text("a"), (root / "b.md").write_text("b")
    query = watch_folder(spark, str(root), path, str(tmp_path / "at"), "1 second", told.append)
    try:
        until = time.time() + 90
        while time.time() < until and not any(x["new"] for x in told):
            time.sleep(0.5)
        (root / "a.md").unlink()
        while time.time() < until and not any(x["deleted"] for x in told):
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r.rel_path for r in keyed.read(spark, path).collect()] == ["b.md"]
