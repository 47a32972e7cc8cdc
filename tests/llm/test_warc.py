"""Archives: round trip, standard files, and what a reader must refuse."""

import gzip
import hashlib

import pytest

from quillspark.llm import warc as W
from quillspark.llm.common import stage

BIG = "<p>é" * 60
ROWS = [(5, "http://x/é b", BIG), (3, None, BIG), (4, "u", BIG), (1, "u", "short"), (2, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", BIG + "n"), (9, "u", BIG * 2), (9, "u", BIG * 2), (10, "u", BIG * 2)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in W.read_archives(stage(W.write_archives(pages), "t")).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        first = min((j for j, _, h in ROWS if j is not None and (h or "") == (html or "")), default=None)
        again = len(body) >= 100 and i is not None and i > first
        want.append((i is None, i or 0, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None, None if again else html or ""))
    assert got == sorted(want, key=str)
    assert all(r.verified for r in W.round_trip(pages).collect())
    assert W.round_trip(pages.where("page_id > 99")).count() == 0


def test_digests_and_revisits_are_held_against_what_they_name(spark):
    ok = hashlib.sha256(BIG.encode()).hexdigest()
    archive = lambda *members: W.read_archives(spark.createDataFrame([("a", 0, bytearray(b"".join(members)))], "archive string, segment int, data binary"))
    with pytest.raises(Exception, match="another digest"):
        archive(W.page_record(1, "u", BIG.encode(), "00" * 32, None)).collect()
    first, again = W.page_record(1, "u", BIG.encode(), ok, None), [W.page_record(i, "u", b, d, to) for i, b, d, to in ((2, BIG.encode(), ok, 1), (3, BIG.encode(), ok, 9), (4, b"x" * 120, ok, 1), (5, BIG.encode(), "11" * 32, 1))]
    assert {r.page_id: r.verified for r in W.referred(archive(first, *again).drop("payload")).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_a_very_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "é" * 6_000_000), (2, "u", "é" * 6_000_000)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.verified) for r in W.round_trip(pages).collect()}
    assert got == {1: (12_000_000, "response", True), 2: (12_000_000, "revisit", True)}


def test_files_are_standard_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<html>{i}</html>" * 20) for i in range(50)], "page_id long, url string, html string")
    W.export(stage(W.write_archives(pages), "t"), str(tmp_path))
    found = []
    for f in tmp_path.iterdir():
        text = gzip.decompress(f.read_bytes()).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo")
        found += [h["warc-record-id"] for h, _ in W.records(W.in_pieces(f.read_bytes(), 7)) if h["warc-type"] == "response"]
    assert sorted(found) == sorted(f"<urn:page:{i}>" for i in range(50))


def test_reader_refuses_broken_archives():
    good = W.page_record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None)
    assert len(list(W.records([good, good[:10], good[10:]]))) == 2
    with pytest.raises(ValueError):
        list(W.records([good, good[:-5]]))
    with pytest.raises(ValueError):
        list(W.records([gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")]))
    with pytest.raises(ValueError):
        list(W.records([gzip.compress(b"no record")]))
