"""SimHash links against brute force, also where buckets overflow."""

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash_dedup as S


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "  \t", "one", "Two Words", "a b c d e f g", "É x é X a b c", "w " * 50])
def test_fingerprint(text):
    assert S.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_query_matches_brute_force(spark, sf_dir):
    from quillspark.llm.queries import op4_simhash_dedup

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(docs)
    fps = [slow_fingerprint(docs[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, slow_components(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash_dedup(spark, sf_dir).collect()}
    assert got == want


def near(rng, base, n, most):
    out = {base}
    while len(out) < n:
        f = sorted(out)[rng.integers(len(out))] if rng.random() < 0.5 else base
        for b in rng.choice(64, rng.integers(1, most + 1), replace=False):
            f ^= 1 << int(b)
        out.add(int(f))
    return sorted(out)


@pytest.mark.parametrize("most", [4, 64, 2048])
def test_links_connect_all_that_are_near(spark, most):
    rng = np.random.default_rng(1)
    fps = near(rng, 0x0123456789ABCDEF, 150, 3) + near(rng, 0xFFFF0000FFFF0000, 60, 2)
    fps += [int(x) for x in rng.integers(0, 2**63, 100)]
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = S.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, most).collect()
    index = {f: i for i, f in enumerate(signed)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        moved = False
        for r in links:
            a, b = label[index[r.a]], label[index[r.b]]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
                moved = True
        if not moved:
            break
    assert label == slow_components(fps)


def test_dedup_keeps_one_of_each_group(spark):
    rows = [(3, "a b c d e", "x"), (1, "A B C d e", "y"), (2, "quite another text here", "z"), (2, "quite another text here", "z"), (7, None, "n"), (8, "", "n"), (None, "a b c d e", "w"), (None, "only one without an id", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep string").withColumnRenamed("rep", "component")
    out = sorted((str(r.doc_id), r.text, r.component) for r in S.simhash_dedup(docs).collect())
    assert out == [("1", "A B C d e", "y"), ("2", "quite another text here", "z"), ("7", None, "n"), ("None", "a b c d e", "w"), ("None", "only one without an id", "w")]
    assert S.simhash_dedup(docs.where("doc_id = 99")).count() == 0
    assert S.simhash_components(docs.where("doc_id = 99")).count() == 0
