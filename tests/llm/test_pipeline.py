"""The pipeline: each stage on what the one before kept; planted cases; edges."""

import random

import corpus_pipeline as P


def planted(spark):
    r = random.Random(8)
    v = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    say = lambda n: " ".join(r.choice(v) for _ in range(n))
    clean = [(i, say(120), "en", f"s{i % 4}") for i in range(60)]
    passage, item = say(70), say(30)
    rows = clean + [(100 + i, say(60) + " you stupid idiot loser " + say(5), "en", "s1") for i in range(20)]
    rows += [(200, clean[3][1], "en", "s1"), (201, clean[4][1].upper(), "en", "s1")]
    rows += [(300 + i, say(50) + " " + passage + " " + say(60), "en", "s2") for i in range(3)]
    rows += [(400, say(40) + " " + item + " " + say(40), "fr", None)]
    rows += [(500, None, None, None), (501, "", "en", "s0"), (500, None, None, None)]
    labels = [(i, 1, int(100 <= i < 120)) for i, *_ in rows if i < 120]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, item)], "item_id long, text string"), passage


def test_planted_cases(spark, tmp_path):
    docs, labels, items, passage = planted(spark)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    left, by_stage = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, step in P.STAGES:
        left = step(spark, left, str(tmp_path))
        if name != "mixing":
            assert left.columns == docs.columns
        left.write.parquet(str(tmp_path / "out" / name))
        left = spark.read.parquet(str(tmp_path / "out" / name))
        by_stage[name] = {r.doc_id: r for r in left.collect()}
    ids = {k: set(x) for k, x in by_stage.items()}
    clean = set(range(60))
    assert clean <= ids["toxicity"] and not ids["toxicity"] & set(range(100, 120))
    assert clean <= ids["near_dedup"] and not ids["near_dedup"] & {200, 201}
    assert [i for i in (300, 301, 302) if passage in by_stage["substrings"][i].text] == [300]
    assert all(by_stage["substrings"][i].text == by_stage["toxicity"][i].text for i in clean)
    assert clean <= ids["decontamination"] and 400 not in ids["decontamination"]
    assert ids["mixing"] <= ids["decontamination"]
    kept = by_stage["decontamination"]
    assert all(r.text == kept[i].text for i, r in by_stage["mixing"].items() if r.words == len(kept[i].text.split()))
    assert P.run(spark, str(tmp_path)).count() == left.count()


def test_empty_tables(spark, tmp_path):
    docs, labels, items, _ = planted(spark)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.where("1 = 0").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_results_of_several_runs_stay(spark, tmp_path):
    docs, labels, items, _ = planted(spark)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    a = P.run(spark, str(tmp_path))
    n = a.count()
    b = P.run(spark, str(tmp_path))
    assert (b.count(), a.count(), b.count(), a.count()) == (n, n, n, n)


def test_stages_called_by_themselves_leave_each_other_alone(spark, tmp_path):
    docs, labels, items, _ = planted(spark)
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    one = [step(spark, docs, str(tmp_path)) for _, step in P.STAGES]
    counts = [x.count() for x in one]
    two = [step(spark, docs, str(tmp_path)) for _, step in P.STAGES]
    assert [x.count() for x in reversed(one)] == counts[::-1] and [x.count() for x in two] == counts


def test_very_long_extra_and_clashing_columns(spark, tmp_path):
    docs, labels, items, _ = planted(spark)
    long = " ".join(f"word{i}" for i in range(150_000))
    docs = docs.union(spark.createDataFrame([(900, long, "en", "s0", len(long))], docs.schema))
    for c in ("score", "_score", "component_id", "block", "taken", "words"):
        docs = docs.selectExpr("*", f"'mine' AS `{c}`")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = P.run(spark, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert {r.score for r in rows} == {r.taken for r in rows} == {"mine"} and any(r.doc_id == 900 for r in rows)
