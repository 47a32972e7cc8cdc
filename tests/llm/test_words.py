"""The word model against the definition, on documents of the other fold, and what character symbols could not tell."""

import random
from collections import defaultdict

import numpy as np

from quillspark.llm import kn_quality as K
from quillspark.llm import word_model as M


def split(text):
    return M.words([text.encode()])[1].tolist()


def plain_log_p(trained, text):
    pad = lambda t: [M.START] * (M.ORDER - 1) + split(t) + [M.END]
    c = {M.ORDER: defaultdict(int)}
    for t in trained:
        s = pad(t)
        for i in range(M.ORDER - 1, len(s)):
            c[M.ORDER][tuple(s[i - M.ORDER + 1 : i + 1])] += 1
    for k in range(M.ORDER - 1, 0, -1):
        c[k] = defaultdict(int)
        for g, n in c[k + 1].items():
            c[k][g[1:]] += n if k > 1 and g[1] == M.START else 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(c[1]) + 1)
        n = [sum(v == j for v in c[k].values()) for j in range(5)]
        d = [0, 0.5, 0.75, 1.0]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.0]
            d = [0] + [min(max(x, 0.05), j - 0.05) for j, x in zip((1, 2, 3), d[1:], strict=True)]
        own = [v for x, v in c[k].items() if x[:-1] == g[:-1]]
        if not own:
            return p(g[1:])
        v = c[k].get(g, 0)
        return (max(v - d[min(v, 3)], 0) + sum(d[min(x, 3)] for x in own) * p(g[1:])) / sum(own)

    s = pad(text)
    return -np.mean([np.log(p(tuple(s[i - M.ORDER + 1 : i + 1]))) for i in range(M.ORDER - 1, len(s))])


def test_words():
    assert len(split("The cat's déjà_vu, 42!")) == 8 and len(split("中文字")) == 3 and not split(" \n")
    assert split("abc") != split("ABC") != split("Abc") and split("кот пёс") == split("кот") + split("пёс")
    doc, w, n = M.words([b"a b", None, b"", b"b"])
    assert doc.tolist() == [0, 0, 3] and w[1] == w[2] and n.tolist() == [3, 0, 0, 1]


def test_model_matches_definition(spark):
    trained = [["the cat sat on the mat.", "The dog! the cat", "the cat sat"], ["кот сидит на окне", "the dog sat on the mat", "на окне кот"]]
    docs = spark.createDataFrame([(t, f) for f in (0, 1) for t in trained[f]], "text string, fold int")
    asked = [(1, "the cat sat on the dog", 0), (2, "the cat sat on the dog", 1), (3, "на окне сидит cat", 0), (4, " ", 0), (5, None, 1), (6, "zzz", 1)]
    model, unknown = M.train(docs)
    got = {r.id: r for r in M.log_perplexities(spark.createDataFrame(asked, "id long, text string, fold int"), model, unknown, ["id"]).collect()}
    assert len(got) == len(asked)
    for i, text, fold in asked:
        if text is None or not text.strip():
            assert got[i].log_perplexity is None
        else:
            assert abs(got[i].log_perplexity - plain_log_p(trained[1 - fold], text)) < 1e-5


def test_scrambled_words_of_any_script_cost(spark):
    r = random.Random(1)
    for letters in ("абвгдежз", "αβγδεζηθ", "abcdefgh", "天地玄黄宇宙洪荒"):
        names = ["".join(r.choices(letters, k=4)) for _ in range(40)]
        chain = lambda: " ".join(names[(s + i) % 40] for s in [r.randrange(40)] for i in range(60))
        rows = [(i, chain()) for i in range(60)]
        bad = []
        for i in range(100, 120):
            w = list("".join(chain().split())) if letters[0] == "天" else chain().split()
            r.shuffle(w)
            bad.append((i, " ".join(w)))
        docs = spark.createDataFrame([(*x, "xx") for x in rows + bad], "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
        kept = {x.doc_id: x.kept for x in K.quality(docs, labels).collect()}
        assert not any(kept[i] for i, _ in bad) and sum(kept[i] for i in range(40, 60)) >= 15


def test_lookup_tasks_grow_with_the_documents(spark):
    r = random.Random(6)
    say = lambda: " ".join(r.choice(["cat", "dog", "sat", "mat", "кот"]) for _ in range(9))
    docs = spark.createDataFrame([(i, say(), i % 2) for i in range(80)], "id long, text string, fold int").repartition(8)
    model, unknown = M.train(docs)
    one, many = (M.log_perplexities(docs, model, unknown, ["id"], x) for x in (1 << 40, 500))
    assert {x.id: x.log_perplexity for x in one.collect()} == {x.id: x.log_perplexity for x in many.collect()}
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    tasks = [int(x._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].split("], ")[1].split(",")[0].split("\n")[0].split(")")[0]) for x in (one, many)]
    assert tasks[0] == 16 and tasks[1] == 16 * (1 + size // 500)


def test_slices_add_up_and_leave_nothing(spark, monkeypatch):
    """Slice after slice gives the sums of one model, also of repeated rows, and no slice's n-grams stay on disk."""
    from quillspark import staging

    r = random.Random(3)
    say = lambda: " ".join(r.choice(["cat", "dog", "sat", "mat", "кот", "the", "."]) for _ in range(r.randint(0, 12)))
    rows = [(i, say(), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:3] + [(0, "another text", 0), (90, None, 1)], "id long, text string, fold int").repartition(3)
    trusted = docs.where("id < 40")
    plain = lambda df: sorted((x.id, x.n_symbols, -1 if x.log_perplexity is None else round(x.log_perplexity, 5)) for x in df.collect())
    one = plain(M.trusted_perplexities(docs, trusted, ["id"]))
    monkeypatch.setattr(M, "SLICED_BYTES", 300)
    made: list = []
    with staging.noted(made):
        many = M.trusted_perplexities(docs, trusted, ["id"])
    left = {path.rsplit("/", 1)[1].split("-")[0] for _, path in made if any(p == path for _, p in staging._staged)}
    assert plain(many) == one and len(one) == 65
    assert left == {"sums"} and sum("/values-" in path for _, path in made) > 3
