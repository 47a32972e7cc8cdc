"""Main text of web pages: nearest-URL page differencing of every page, and what it leaves checked against block structure.

``blocks`` cuts a page into text blocks (lines) and says of each what the markup says: MAIN (inside article or main),
BOILER (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element, role or names in class and
id), or OPEN. An article or main inside an element that only its names or being a form make boilerplate is MAIN again,
unless its own names do. Inside an article ids are anchors of its parts and say nothing, but those of reader comments; of
headings they never do. A heading such as "Comments" makes boilerplate of the section that it begins, or else of the
articles that follow beside it.

Pages of a host are sorted by URL path, each is aligned with its neighbours on both sides by longest common subsequence of
lines, and the lines that it shares with them are deleted. What is left is checked against the markup: BOILER lines go
though no neighbour has them, and MAIN lines stay though a neighbour has them too. Where a page has MAIN lines they are
its text, otherwise the OPEN lines that differencing left are.

Differencing alone isn't used because it can't give right results: boilerplate that differs from page to page stays,
and an article that two neighbouring pages share would go (README has figures).

A host is never gathered: pages are range-sorted by host and path, and a task reads them in that order with the page before
at hand. A partition's first and last page meet their other neighbours in a table of two rows a partition.

Defined cases: null or empty html gives an empty text. A null url belongs to host '' with an empty path. Pages of one
host with one path are ordered by page_id, then by url and content. A page of which all OPEN lines are shared is kept whole:
it is a copy, not boilerplate. Pages of any length and nesting take time in proportion to their length. Aligning two pages takes
time in proportion to their lines and pairs of equal lines; where these are many more than the lines, to the product of
the lines that both have, and memory to their sum. Repeated rows are one page, with a row each. Extra columns are not read.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_CHARS, slices, stage

MAIN, OPEN, BOILER, LOOSE = 0, 1, 2, 3  # LOOSE: boilerplate in which an article may stand
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is never text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "button"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements of choices; a page may leave out their end tags, so they end with their parent or at another block.
CHOICES = {"option", "optgroup"}
BOILER_TAGS = {"nav", "header", "footer", "aside", "dialog", "menu", "datalist"} | CHOICES
MAIN_TAGS = {"article", "main"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form", "alertdialog"}
#: What a name in class or id says by its last part that isn't in CONTAINERS: boilerplate, or the article.
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments disqus "
    "respond response responses cookie cookies consent gdpr footer header masthead menu menus nav navbar navigation "
    "newsletter subscribe notice notices popup modal promo promos related recommended recommendations replies reply share "
    "sharing sidebar social sponsor sponsored subscription teaser teasers toolbar widget widgets login signup paywall disclaimer skip".split()
)
#: Names that say so by their last two parts.
BOILER_PAIRS = {"also-like", "read-next", "up-next"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Ids that say so inside an article too; other ids there, and those of headings, are anchors of its own parts.
COMMENT_IDS = {"comment", "comments", "disqus", "replies", "respond"}
#: A heading that begins a section of reader comments, whatever the section is called.
COMMENT_HEADINGS = {"comments", "reader comments", "leave a comment", "leave a reply", "kommentare", "commentaires", "comentarios"}
MAIN_NAMES = {"article", "articlebody", "entry-content", "post-content", "main-content", "story", "story-body", "post-body", "article-body", "article-content"}
CONTAINERS = {"area", "bar", "block", "body", "box", "buttons", "container", "content", "form", "inner", "item", "items", "link", "links", "list", "outer", "panel", "section", "slot", "text", "thread", "top", "unit", "wrap", "wrapper"}
#: A name that begins so is about the layout of what it is on.
LAYOUT = {"has", "is", "js", "no", "not", "with", "without"}
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for t in RAW}
#: What a start tag of the first closes when it is open.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": CHOICES}


def _parts(name: str) -> tuple[str, list[str]]:
    name = re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower().replace("_", "-").strip("-")
    return name, [x for x in name.split("-") if x and not x.isdigit()]


@lru_cache(maxsize=4096)
def _named(names: str) -> int:
    """What the names of class and id say: BOILER, MAIN or OPEN."""
    out = OPEN
    for name in names.split():
        name, parts = _parts(name)
        if not parts or parts[0] in LAYOUT:
            continue
        if name in MAIN_NAMES:
            out = MAIN
            continue
        while len(parts) > 1 and parts[-1] in CONTAINERS:
            parts.pop()
        if parts[-1] in BOILER_NAMES or "-".join(parts[-2:]) in BOILER_PAIRS:
            return BOILER
        if "-".join(parts) in MAIN_NAMES:
            out = MAIN
    return out


def _of_comments(name: str) -> bool:
    parts = _parts(name)[1]
    while len(parts) > 1 and parts[-1] in CONTAINERS:
        parts.pop()
    return bool(parts) and parts[-1] in COMMENT_IDS


def _kind(tag: str, attributes: str, above: int) -> int:
    names, role, hidden = "", "", False
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), a or b or c
        if name == "class" or name == "id" and tag not in HEADINGS and (above != MAIN or _of_comments(value)):
            names += f" {value}"
        elif name == "role":
            role = value.strip().lower()
        elif name == "style":
            hidden = hidden or bool(HIDDEN.search(value.lower()))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
    if above == BOILER or hidden or role in BOILER_ROLES or tag in BOILER_TAGS:
        return BOILER
    said = _named(names) if names and tag not in ("body", "html") else OPEN
    main = tag in MAIN_TAGS or role in ("main", "article")
    if said == BOILER:
        return BOILER if main or above == MAIN else LOOSE
    if main:
        return MAIN
    if tag == "form":
        return BOILER if above == MAIN else LOOSE
    return MAIN if said == MAIN and above == OPEN else above


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of a page's text blocks in order. Text between block-level tags is one block, white space inside
    is one space; br is white space."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", OPEN)]
    begins: list[int] = [0]  # blocks before each open element
    held: list[str] = []
    many: Counter[str] = Counter()  # open elements of each name
    commented = 0  # how deep an element is whose articles are comments from now on

    def push(tag: str, kind: int) -> None:
        stack.append((tag, kind))
        begins.append(len(out))
        many[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        begins.pop()
        many[tag] -= 1
        return tag

    def comments_begin() -> int:
        """After a heading of reader comments: the section that it begins is boilerplate, else articles beside it are."""
        tag, kind = stack[-1]
        out[-1] = (out[-1][0], BOILER)
        if tag in ("div", "section") and begins[-1] == len(out) - 1:
            stack[-1] = (tag, BOILER)
            return commented
        return len(stack)

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", htmllib.unescape("".join(held))).strip()
            if text:
                out.append((text, min(stack[-1][1], BOILER)))
            held.clear()

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end() if m.end() > at else at + 1
        closing, tag, attributes = m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                stop = RAW_END[tag].search(page, at)
                at = stop.end() if stop else end
            if tag not in INLINE:
                held.append(" ")
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                held.append(" " if tag != "wbr" else "")
            elif not closing and attributes:
                kind = _kind(tag, attributes, stack[-1][1])
                if kind in (BOILER, LOOSE) and stack[-1][1] not in (BOILER, LOOSE):
                    flush()
                    push(tag, kind)
            elif closing and stack[-1][0] == tag:
                flush()
                pop()
            continue
        flush()
        if closing:
            said = tag in HEADINGS and stack[-1][0] == tag and begins[-1] == len(out) - 1 and out[-1][0].lower().strip(" ():0123456789")
            while many[tag] and pop() != tag:
                pass
            commented = 0 if len(stack) < commented else commented
            if said in COMMENT_HEADINGS:
                commented = comments_begin()
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        while stack[-1][0] in CHOICES and tag not in CHOICES:
            pop()
        if tag in CLOSES and stack[-1][0] in CLOSES[tag]:
            pop()
        push(tag, BOILER if tag == "article" and len(stack) == commented else _kind(tag, attributes, stack[-1][1]))
    flush()
    return out


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _common(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Places in x and y of a longest common subsequence, in memory of their sum: x is halved, y parted where the two
    halves' lengths add up to the most."""
    in_x, in_y, todo = [], [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if b - a == 0 or c == d:
            continue
        if b - a == 1:
            if (same := y[c:d] == x[a]).any():
                in_x.append(a), in_y.append(c + int(same.argmax()))
            continue
        mid = (a + b) // 2
        left, right = _lengths(x[a:mid], y[c:d]), _lengths(x[mid:b][::-1], y[c:d][::-1])[::-1]
        at = c + int((left + right).argmax())
        todo += [(a, mid, c, at), (mid, b, at, d)]
    return in_x, in_y


def _matched(x: list[int], y: list[int]) -> tuple[list[int], list[int]] | None:
    """Places in x and y of a longest common subsequence: the longest rising run of y's places. None where lines repeat so
    often that there are many more pairs of equal lines than lines."""
    places: dict[int, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j], []).append(j)
    if sum(len(places.get(v, ())) for v in x) > 4 * (len(x) + len(y)):
        return None
    ends: list[int] = []  # the least place in y where a run of each length ends
    last: list[tuple] = []  # that run: (place in x, place in y, the run before)
    for i, v in enumerate(x):
        for j in places.get(v, ()):
            k = bisect_left(ends, j)
            run = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j), last.append(run)
            else:
                ends[k], last[k] = j, run
    run, in_x, in_y = last[-1] if last else None, [], []
    while run:
        i, j, run = run
        in_x.append(i), in_y.append(j)
    return in_x, in_y


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of a's and of b's lines (hashes) are in a longest common subsequence of both. Equal ends are cut off first,
    and lines that the other page lacks."""
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    n = min(len(a), len(b))
    i = int(np.append(a[:n] != b[:n], True).argmax())
    j = int(np.append(a[len(a) - n + i :][::-1] != b[len(b) - n + i :][::-1], True).argmax())
    in_a[:i] = in_b[:i] = True
    in_a[len(a) - j :] = in_b[len(b) - j :] = True
    x, y = a[i : len(a) - j].tolist(), b[i : len(b) - j].tolist()
    both = set(x) & set(y)
    if not both:
        return in_a, in_b
    at_x, at_y = [k for k, v in enumerate(x) if v in both], [k for k, v in enumerate(y) if v in both]
    x, y = [x[k] for k in at_x], [y[k] for k in at_y]
    found = _matched(x, y) or _common(np.array(x), np.array(y))
    in_a[[i + at_x[k] for k in found[0]]] = True
    in_b[[i + at_y[k] for k in found[1]]] = True
    return in_a, in_b


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a's lines ``aligned`` finds in b."""
    return aligned(a, b)[0]


def _hashes(lines: list[tuple[str, int]]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _ in lines], np.int64)


def checked(lines: list[tuple[str, int]], shared: list[bool]) -> str:
    """The text of a page's lines that differencing leaves, checked against the markup.

    A line that the neighbours don't share is left. The markup overrules that where it says so: boilerplate goes though
    no neighbour has it, an article stays though a neighbour has its lines too, and beside an article open lines go."""
    left = [k != BOILER and not s for (_, k), s in zip(lines, shared, strict=True)]
    if any(k == MAIN for _, k in lines):
        left = [k == MAIN for _, k in lines]
    elif not any(left):
        left = [k == OPEN for _, k in lines]
    return "\n".join(t for (t, _), x in zip(lines, left, strict=True) if x)


@dataclass
class _Page:
    key: tuple
    host: str
    lines: list[tuple[str, int]]
    hashes: np.ndarray
    shared: np.ndarray
    copies: int = 1


FIRST, LAST, ONLY = 0, 1, 2
ROWS = "page_id long, url string, text string, copies int, block int, place int, host string, lines array<struct<text: string, kind: int>>, hashes array<bigint>, shared array<boolean>"


def differenced(pages: DataFrame) -> DataFrame:
    """Every page beside its nearest ones: pages are range-sorted by host and path, and each is aligned with the page before
    and the page after it in its host.

    A row has its text, or, as a partition's FIRST or LAST page, whose other neighbour is in another partition, what is
    needed to go on: its lines, their hashes and which are shared so far. Rows of equal id, url and html are one page with
    copies; a task holds one page and the one before it, and a batch of texts. Pages are packed before they are shuffled.
    """
    kind = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32())]))
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", ROWS)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for part, htmls in slices(batch, "html"):
                packed = [None if x is None else codec.compress(x, asbytes=True) for x in htmls]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(x or b"") for x in htmls], pa.int64()), pa.array(packed, pa.binary())], names=[*part.schema.names[:-1], "size", "packed"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Page, int | None]]:
        before, now, first, codec = None, None, True, pa.Codec("zstd")
        for batch in batches:
            for part, packed in slices(batch, "packed"):
                for page_id, url, host, size, html in zip(*(part.column(i).to_pylist() for i in range(4)), packed, strict=True):
                    html = codec.decompress(html, size, asbytes=True) if size else html and b""
                    key = page_id, url, html
                    if now is not None and now.key == key:
                        now.copies += 1
                        continue
                    found = blocks(html.decode("utf-8", "replace")) if html else []
                    before, now = now, _Page(key, host, found, _hashes(found), np.zeros(len(found), bool))
                    if before is None:
                        continue
                    if before.host == host:
                        a, b = aligned(before.hashes, now.hashes)
                        before.shared |= a
                        now.shared |= b
                    yield before, FIRST if first else None
                    first = False
        if now is not None:
            yield now, ONLY if first else LAST

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId(), [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), kind, pa.list_(pa.int64()), pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for page, place in rows(batches):
            if place is None:
                text = checked(page.lines, page.shared.tolist())
                held.append((*page.key[:2], text, page.copies, block, None, None, None, None, None))
                size += len(text)
            else:
                lines = [{"text": t if k != BOILER else None, "kind": k} for t, k in page.lines]
                held.append((*page.key[:2], None, page.copies, block, place, page.host, lines, page.hashes.tolist(), page.shared.tolist()))
            if size >= SLICE_CHARS or len(held) >= 2000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    # Equal rows have equal keys, so they meet in one partition.
    order = ["host", "path", "page_id", "url", "digest"]
    keyed = base.select("page_id", "url", host.alias("host"), path.alias("path"), F.xxhash64("html").alias("digest"), "html")
    packed = keyed.mapInArrow(pack, "page_id long, url string, host string, path string, digest long, size long, packed binary")
    return packed.repartitionByRange(*order).sortWithinPartitions(*order).select("page_id", "url", "host", "size", "packed").mapInArrow(each, ROWS)


def across_partitions(ends: DataFrame) -> DataFrame:
    """(page_id, url, text, copies) of the partitions' first and last pages (two rows a partition), by their neighbours in
    other partitions."""
    w = W.orderBy("block", "place")
    near = [F.when(F.col("place") != other, F.when(f("host").over(w) == F.col("host"), f("hashes").over(w))) for f, other in ((F.lag, LAST), (F.lead, FIRST))]
    met = ends.select("page_id", "url", "copies", "lines", "hashes", "shared", near[0].alias("near_0"), near[1].alias("near_1"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lines, hashes, shared, *near in zip(*(batch.column(i).to_pylist() for i in range(3, 8)), strict=True):
                hit = np.array(shared, bool)
                for other in near:
                    if other:
                        hit |= shared_lines(np.array(hashes, np.int64), np.array(other, np.int64))
                texts.append(checked([(x["text"], x["kind"]) for x in lines], hit.tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), batch.column(2)], names=["page_id", "url", "text", "copies"])

    return met.mapInArrow(each, "page_id long, url string, text string, copies int")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = stage(differenced(pages), "pages")
    all_ = found.where("place is null").select("page_id", "url", "text", "copies").union(across_partitions(found.where("place is not null")))
    out = all_.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
