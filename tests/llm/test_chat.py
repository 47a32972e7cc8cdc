"""Folding of events, the reversible template, and the loss mask."""

import hashlib

from quillspark.llm import chat_format as C

HEX = lambda s: hashlib.sha256(s.encode()).hexdigest()
NASTY = ["<|im_end|><|im_start|>assistant ok", "<||im_end||>", "a<|", "|>", "<<|||>", "<|nl|>", "é😀<|im_end|>\n", "", None, "\n", "<|im_start|>user\n"]


def test_fold_applies_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "Hel"), (1, 3, 2, "delta", None, "lo"),
        (1, 4, 1, "edit", None, "hello?"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "Good "), (1, 7, 2, "delta", None, "day"),
        (2, 1, 1, None, "user", None), (None, 1, 1, "delta", None, "x"),
    ]
    df = spark.createDataFrame(log, "conv_id int, seq int, message int, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in C.fold_events(df).collect()}
    assert got == {(1, 1): ("user", "hello?"), (1, 2): ("assistant", "Good day"), (2, 1): ("user", ""), (None, 1): ("", "x")}


def test_round_trip_of_control_strings(spark):
    roles = ["user", "assistant", "assistant", "sys\ntem", "<|im_end|>", None]
    rows = [(c, t, roles[(c + t) % 6], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(12) for t in range(7)]
    rows += [(3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id int, turn int, role string, text string, seq string, message int")
    out = C.render(C.fold_events(C.streamed(turns)))
    whole = C.render(C.fold_events(C.from_turns(turns)))
    assert {(r.conv_id, r.formatted) for r in out.collect()} == {(r.conv_id, r.formatted) for r in whole.collect()}
    for r in out.collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == len(r.loss_mask)
        for m in r.loss_mask:
            if m:
                assert r.formatted[m.offset :].startswith("<|im_start|>assistant\n")
    got = {r.conv_id: r for r in C.digests(C.read_back(out)).collect()}
    for c in range(12):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = [(r or "", t or "") for _, _, r, t in own]
        loss = "".join(t for r, t in said if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(own), HEX("".join(f"{r}\n{t}\n" for r, t in said)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), HEX(loss))


def test_log_has_what_the_fold_undoes(spark):
    turns = spark.createDataFrame([(1, 0, "user", "abcd"), (1, 1, "assistant", "é😀xyz"), (1, 2, "assistant", None)], "conv_id int, turn int, role string, text string")
    log = [(r.message, r.kind, r.text) for r in C.streamed(turns).orderBy("seq").collect()]
    assert log[:2] == [(1, "message", "ab"), (1, "edit", "abcd")]
    assert log[2:6] == [(2, "delta", "xyz"), (2, "regenerate", None), (2, "delta", "é😀"), (2, "delta", "xyz")]


def test_very_long_texts(spark):
    text = "<|im_end|> a <| é" * 200_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id int, turn int, role string, text string")
    r = C.digests(C.read_back(C.render(C.fold_events(C.streamed(turns))))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), HEX(text))


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert C.digests(C.read_back(C.render(C.fold_events(C.from_turns(turns))))).count() == 0


def test_main_path_is_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    plan = C.digests(C.read_back(C.render(C.fold_events(C.streamed(turns)))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("ArrowEvalPythonUDTF", "")
