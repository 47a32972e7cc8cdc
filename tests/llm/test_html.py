"""Blocks, page differencing and whole pages."""

import time
import tracemalloc

import numpy as np

from quillspark.llm import html_extract as H


def text_of(page):
    return "\n".join(t for t, k in H.blocks(page) if k == H.MAIN)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body>
<header class="site">Head</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">Cookies!</div>
<article><h1>Big &amp; <i>bold</i></h1><p>One
  two&nbsp;three<br>four<p>Open <b>tags<div class="ad-box">Buy</div><aside>Aside</aside><form><p>Sign up</p></form>
<ul><li>a<li>b &lt;x&gt; &#233; &copy &amp;lt;</ul><!-- hidden <p>x</p> --><section class="comments"><p>Reader: nice</p></section><p>5 < 6</p></article>
<footer>Foot</footer></body>"""


def test_article_only():
    assert text_of(PAGE) == "Big & bold\nOne two three four\nOpen tags\na\nb <x> é © &lt;\n5 < 6"


def test_broken_markup():
    for page in ("", "<", "<p", "text only", "<article>cut in a ta<b", "<article><p>x</article><p>y", "<script>never closed", "<article>&am", "<div title=\"a > b\">q</div>", "<article><p a='1>x</p>", "</article></p>"):
        H.blocks(page)
    assert text_of("<article>cut in <b>a ta</b") == "cut in a ta" and text_of("<article>&am") == "&am"
    assert text_of("<main><p>m</p></main>") == "m" and text_of('<div class="post-content"><p>m</p></div>') == "m"


def test_an_article_wins_over_names_around_it():
    for page in (
        '<div class="layout has-sidebar"><article><p>m</p></article></div>', '<div id="page" class="no-sidebar"><main><p>m</p></main></div>',
        '<div class="social-story"><article>m</article></div>', '<form id="aspnetForm"><div class="content-sidebar"><article>m</article></div></form>',
        '<div class="menu-wrapper"><div role="main">m</div><ul class="menu"><li>x</li></ul></div>', '<body class="popup nav-open"><article class="post-17 has-comments">m</article>',
    ):
        assert text_of(page) == "m", page
    for inside in (
        '<article class="comment"><p>x</p></article>', '<div class="reader-responses">x</div>', '<p style="display: none">x</p>', '<div class="cookieNotice">x</div>',
        '<section id="comments-list-2">x</section>', '<div class="ad_box_wrapper"><p>x</p></div>', "<form>x</form>", "<p hidden>x</p>", '<div aria-hidden="true">x</div>',
        '<span class="sponsored">x</span>',
    ):
        assert text_of(f"<article><p>m</p>{inside}<p class='notice-board-history'>n</p></article>") == "m\nn", inside
    assert text_of('<nav><article>x</article></nav><aside><article>y</article></aside><article>m</article>') == "m"


def test_long_and_deep_pages_take_linear_time():
    start = time.monotonic()
    deep = "<div>" * 20_000 + "</p>" * 20_000 + "<article>m" + "</b></div>" * 20_000
    assert text_of(deep) == "m"
    lines = "".join(f"<p>line {i}</p>" for i in range(50_000))
    assert text_of(f"<article>{lines}</article>").count("\n") == 49_999
    assert time.monotonic() - start < 20


def test_aligning_long_pages_needs_memory_of_their_sum():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 3000, 3000), r.integers(0, 3000, 3000)
    tracemalloc.start()
    hit = H.shared_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()
    own = iter(b.tolist())
    assert hit.sum() > 50 and all(x in own for x in a[hit].tolist())
    same = np.arange(50_000)
    assert H.shared_lines(same, np.delete(same, 25_000)).sum() == 49_999


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(0, 14)), r.integers(0, 6, r.integers(0, 14))
        hit = H.shared_lines(a, b)
        assert hit.sum() == slow_lcs(a.tolist(), b.tolist())
        own = iter(b.tolist())
        assert all(x in own for x in a[hit].tolist())


def test_differencing_deletes_what_neighbours_share(spark):
    page = lambda body: f"<html><body><div>Welcome to our site</div><div>{body}</div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h.org/a/{i}", page(f"Story number {i}")) for i in range(9)]
    rows += [(20, "http://alone.org/x", page("Lonely")), (21, "http://twins.org/1", page("Same")), (22, "http://twins.org/2", page("Same"))]
    rows += [(30, "http://h.org/a/30", "<article><p>Welcome to our site</p></article>"), (31, None, None), (32, "u", ""), (33, "http://h.org/a/2", rows[2][2])]
    pages = spark.createDataFrame([(*r, "k", 2) for r in rows], "page_id long, url string, html string, row string, host int")
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.page_id: r.text for r in H.extract_text(pages).collect()}
        assert all(got[i] == f"Story number {i}" for i in range(9) if i != 2)
        assert got[20] == "Welcome to our site\nLonely\nAll rights reserved" and got[21] == got[22] == "Welcome to our site\nSame\nAll rights reserved"
        assert got[30] == "Welcome to our site" and got[31] == got[32] == "" and len(got) == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert H.extract_text(pages.where("page_id > 99")).count() == 0


def test_anchors_inside_an_article_stay():
    kept = lambda page: [t for t, k in H.blocks(page) if k == H.MAIN]
    page = '<body><div id="widgets"><p>w</p></div><article><h2 id="response">Response of the market</h2><p>z</p><h3 id="widgets">Widgets</h3><p>y</p></article>'
    assert kept(page) == ["Response of the market", "z", "Widgets", "y"]
    page = '<article><section id="consent"><h2 id="cookies">On cookies</h2><p>a</p></section><div id="related_work"><p>b</p></div></article>'
    assert kept(page) == ["On cookies", "a", "b"]
    assert kept('<article><p>a</p><div id="comments"><p>no</p></div><section id="respond"><p>no</p></section><div class="widget"><p>no</p></div></article>') == ["a"]
    assert [k for _, k in H.blocks('<div id="newsletter"><p>no</p></div><p>yes</p>')] == [H.BOILER, H.OPEN]


def test_teasers_and_reader_comments_go():
    kept = lambda page: [t for t, k in H.blocks(page) if k == H.MAIN]
    assert kept('<article><p>a</p><div class="you-may-also-like"><p>no</p></div><article class="teaser"><p>no</p></article><p>b</p></article>') == ["a", "b"]
    unnamed = "<section><h2>Comments (12)</h2><article><p>no</p></article><div><p>no</p></div></section>"
    assert kept(f"<article><h1>T</h1><p>a</p>{unnamed}</article>") == ["T", "a"]
    assert kept(f"<main><article><p>a</p></article>{unnamed}<article><p>b</p></article></main>") == ["a", "b"]
    assert kept("<main><article><p>a</p></article><h3>Kommentare</h3><article><p>no</p></article></main>") == ["a"]
    # An article may speak of comments, and go on.
    assert kept("<article><p>a</p><h2>Comments</h2><p>b</p><section><p>c</p><h2>Comments</h2><p>d</p></section></article>") == ["a", "b", "c", "d"]


def test_every_page_meets_its_nearest_ones(spark):
    page = lambda body: f"<html><body><div>Welcome</div><article><p>{body}</p></article><div>All rights</div></body></html>"
    rows = [(i, f"http://h.org/{i:02}", page(f"Story {i}")) for i in range(12)] + [(20, "http://h.org/03", None)]
    rows += [(5, "http://h.org/05", page("Story 5"))] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen = []
        for r in H.differenced(pages).collect():
            if r.place is not None:
                seen += [(r.page_id, x["text"], s) for x, s in zip(r.lines, r.shared, strict=True)]
        assert {(i, s) for i, t, s in seen if t == "Welcome"} >= ({(0, True), (11, True)} if parts == 1 else set())
        assert not any(s for _, t, s in seen if t and t.startswith("Story"))
        got = [(r.page_id, r.text) for r in H.extract_text(pages).collect()]
        assert sorted(got) == sorted((r[0], f"Story {r[0]}" if r[2] else "") for r in rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_aligning_says_it_for_both_pages():
    r = np.random.default_rng(3)
    for top in (3, 8, 40):
        for _ in range(60):
            a, b = r.integers(0, top, r.integers(0, 40)), r.integers(0, top, r.integers(0, 40))
            in_a, in_b = H.aligned(a, b)
            assert a[in_a].tolist() == b[in_b].tolist() and in_a.sum() == slow_lcs(a.tolist(), b.tolist())
