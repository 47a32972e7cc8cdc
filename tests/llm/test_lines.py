"""Line dedup against a plain version; edges."""

import random
from collections import defaultdict

from quillspark.llm import line_dedup as L

STRIP = " \t\n\x0b\x0c\r"


def plain(rows, least_docs=5, least_chars=40):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(STRIP).translate(lower)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                held[key(x)].add(d if d is not None else f"text {t}")
    keeper = {k: max((d for d in v if isinstance(d, int)), default=None) for k, v in held.items() if len(v) >= least_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keeper.get(key(x)) is None or keeper[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(left), t if len(left) == len(lines) else "\n".join(left)))
    return out


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in L.line_dedup(docs, **more).collect()]


def same(got, want):
    order = lambda x: (x[0] is None, x[0] or 0, str(x[3]), x[2])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_equals_plain_on_random_texts(spark):
    r = random.Random(4)
    pool = ["".join(r.choice("aBcé ÀÉ\t") for _ in range(r.randint(36, 60))) for _ in range(60)]
    line = lambda: r.choice(pool[:4] if r.random() < 0.4 else pool).swapcase() if r.random() < 0.2 else r.choice(pool)
    rows = [(i, "\n".join(line() for _ in range(r.randint(0, 12)))) for i in range(120)]
    same(run(spark, rows), plain(rows))
    same(run(spark, rows, least_docs=20, least_chars=50), plain(rows, 20, 50))


A = "This very line is found in a lot of documents, and long enough"


def test_exactly_the_thresholds(spark):
    forty, short = "x" * 40, "y" * 39
    rows = [(i, f"{forty}\n {forty.upper()}\t\n{short}\nown {i}") for i in range(5)] + [(10 + i, A) for i in range(4)]
    got = {x[0]: x for x in run(spark, rows)}
    assert all(got[i][2:] == (2, f"{short}\nown {i}") for i in range(4)) and got[4] == (4, 4, 0, rows[4][1])
    assert all(got[10 + i] == (10 + i, 1, 0, A) for i in range(4))


def test_only_a_to_z_are_lowered_and_only_ascii_space_is_stripped(spark):
    e, nb = "É" * 45, "z" * 40
    rows = [(i, e if i % 2 else e.lower()) for i in range(8)] + [(20 + i, nb + (" " if i % 2 else "\r")) for i in range(8)]
    assert not any(x[2] for x in run(spark, rows))


def test_a_line_in_every_document(spark):
    rows = [(i, f"{A}\n{A} \nrest {i}") for i in range(400)]
    got = {x[0]: x for x in run(spark, rows)}
    assert got[399][2] == 0 and all(got[i][1:] == (3, 2, f"rest {i}") for i in range(399))


def test_rows_of_one_id_are_one_document_and_rows_without_one_are_by_text(spark):
    again = [(7, A)] * 9 + [(None, A)] * 3
    same(run(spark, again), plain(again))  # two documents
    assert not any(x[2] for x in run(spark, again))
    alone = [(None, f"{A}\n{i}") for i in range(6)]
    assert not any(x[2] for x in run(spark, alone))
    same(run(spark, [*alone, (3, A), (3, f"{A}\nb"), (3, "c")]), plain([*alone, (3, A), (3, f"{A}\nb"), (3, "c")]))


def test_null_empty_long_and_extra_columns(spark):
    long = "\n".join([A, *(f"line {i}" for i in range(200_000))])
    rows = [(1, None), (2, ""), (3, "\n"), (4, long), *((10 + i, A) for i in range(5))]
    docs = spark.createDataFrame([(*r, 5, "k", None) for r in rows], "doc_id long, text string, n_lines int, key string, _dropped string")
    out = L.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines_1", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[1].text, got[1].n_lines_1, got[2].text, got[3].text, got[3].n_lines_1) == (None, 1, "", "\n", 2)
    assert got[4].text == long[len(A) + 1 :] and got[4].n_dropped == 1 and got[4].n_lines == 5 and got[4].key == "k"
    assert got[10].text == "" and got[14].text == A
    assert L.line_dedup(docs.where("doc_id = 99")).count() == 0


def test_frequent_lines_report(spark):
    docs = spark.createDataFrame([(i, A + "\n" + "b" * 50) for i in range(6)] + [(9, A)], "doc_id long, text string")
    assert sorted((r.n_docs, r.keeper) for r in L.frequent_lines(docs).collect()) == [(6, 5), (7, 9)]


def test_texts_are_shuffled_once_and_lines_without_their_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = L._lines(docs, 40)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan and "Exchange" not in plan
    whole = L.line_dedup(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert whole.count("Join") == 2
