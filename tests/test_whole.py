"""Entities of whole texts."""

import re
from itertools import combinations

from quillspark.plans import QUERIES


def test_entities_after_the_fortieth_word(spark, tmp_path):
    texts = {1: "w " * 50 + "Alphabet and Betatest met. Gammaray left.", 2: "Onething first. " + "v " * 45 + "Twothings with onething, alone.", 3: "short", 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in texts.items():
        names = {w for w in t.split() if len(w) >= 7}
        for s in re.split(r"(?<=[.!?])\s+", t):
            want |= {(i, *p) for p in combinations(sorted(n for n in names if n.lower() in s.lower()), 2)}
    got = {(r.doc_id, r.src, r.dst) for r in QUERIES["cooccurring_entities"](spark, str(tmp_path)).collect()}
    assert got == want and (1, "Alphabet", "Betatest") in got
