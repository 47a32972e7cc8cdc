"""Reversible formats and scanners on generated input."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.llm import chat_format as C
from quillspark.llm import html_extract as H
from quillspark.llm import substring_dedup as S
from quillspark.llm import warc as W

MARKS = st.lists(st.sampled_from(["<", "|", ">", "im_end", "im_start", "nl", "\n", "a", "é", "\\", "<|im_end|>", "<|im_start|>user\n"]), max_size=12).map("".join)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(MARKS, MARKS), min_size=40, max_size=40))
def test_chat_round_trip(spark, turns):
    rows = [(i // 4, i, role, text) for i, (role, text) in enumerate(turns)]
    out = C.read_back(C.render(C.fold_events(C.from_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))))
    for r in out.collect():
        assert [tuple(t) for t in r.turns] == [(a, b) for c, _, a, b in rows if c == r.conv_id]


@given(st.binary(max_size=300), st.integers(1, 50))
def test_warc_members(payload, piece):
    data = b"".join(W.member([("WARC-Type", "x"), ("N", i)], payload) for i in range(3))
    assert [b for _, b in W.records(W.in_pieces(data, piece))] == [payload] * 3


@given(st.text(st.sampled_from("<>/!-=\"' &;apdivrticlescrnouml"), max_size=60))
def test_html_never_fails(page):
    assert all(t == t.strip() and t for t, _ in H.blocks(page))


@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc", "é"]), max_size=60), max_size=5))
def test_chunks_partition_words(docs):
    c = S.Chunks([" ".join(w).encode() for w in docs])
    size = c.end - c.start
    assert [int(size[c.doc == i].sum()) for i in range(len(docs))] == [len(w) for w in docs]
    assert (size > 0).all() and (size <= S.WIDTH).all() and len(c.digest) == len(size)


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_shared_lines_are_symmetric_in_number(a, b):
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    assert H.shared_lines(x, y).sum() == H.shared_lines(y, x).sum()
