"""Text functions against plain Python on generated texts, many texts to a job."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import parsing as P
from quillspark.functions import text as T

TEXT = st.text(st.sampled_from("ab Éß9_.!?\n#-,"), max_size=80)
FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(st.lists(TEXT, min_size=60, max_size=60))
def test_splits_and_tokens(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    rows = df.select("t", T.sentences(t).alias("s"), T.chunk_fixed(t, 2, 1).alias("f"), T.tokens(t).alias("k"), T.chunk_words(t, 3, 2).alias("w"), T.checksum(t).alias("c")).collect()
    for r in rows:
        assert r.s == [x.strip() for x in re.split(r"(?<=[.!?])\s+|(?<=\n)\s*", r.t) if x.strip()]
        # Eight characters each (less only after the cut of white space), every fourth one; they leave nothing out.
        assert all(0 < len(x) <= 8 and x == x.strip() and x in r.t for x in r.f)
        assert len(r.f) <= max(1, -(-(len(r.t) - 4) // 4)) and bool(r.f) == bool(r.t.strip())
        assert set("".join(r.f)) == set(r.t) - set(" \t\n\x0b\x0c\r") | (set("".join(r.f)) & set(" \n"))
        for i in range(0, max(1, len(r.t) - 4), 4):
            assert not r.t[i : i + 8].strip() or r.t[i : i + 8].strip(" \t\n\x0b\x0c\r") in r.f
        assert r.k == re.findall(r"\w+", r.t.lower())
        w = r.t.split()
        assert r.w == [" ".join(w[i : i + 3]) for i in range(0, len(w), 2) if i == 0 or i - 2 + 3 < len(w)]
        assert r.c == hashlib.sha256(r.t.encode()).hexdigest()


@given(st.text(st.sampled_from('{}[]"\\ab:1,'), max_size=40))
def test_scanners_never_fail(text):
    P.first_object(text), P.all_objects(text), P.relation_list(text), P.reasoned_relations(text)
