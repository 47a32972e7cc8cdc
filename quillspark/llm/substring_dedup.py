"""Substring deduplication by content-defined chunks.

Texts are words between ASCII white space, joined by one space. A gear rolling hash over the last 16 bytes is taken at
each word's end; an end is a cut when its hash is the least of some ``WIDTH`` neighbouring ends of its text. So a chunk
has at most ``WIDTH`` words whatever the text says, and an insertion moves only the cuts beside it: two texts that have
50 words in common have the chunk in the middle of those words in common. A chunk is known by a 64-bit digest.

1. Chunks are deduplicated by digest: a digest that two different texts have is shared. Texts that are the same
   altogether are one text, which the smallest id owns; its copies are repeated as a whole.
2. ``MIN_WORDS`` neighbouring words are a candidate window where the chunks in their middle, which are the same
   wherever those words stand, are shared. A window (a 64-bit hash) is a repeat in every document but the one with the smallest id that has it. Repeats that touch or
   overlap are one passage.

So passages are exact: a word is cut if and only if it is in ``MIN_WORDS`` neighbouring words that a document with a
smaller id has too (hash collisions of 64 bits aside). A document that repeats only itself is left alone.

Volume: a row (digest, text) for each distinct chunk and one for each candidate window. Owners are minima, combined
before the shuffle; repeats are found by joins with staged tables, which adaptive execution splits, so a chunk, window
or text that a third of all documents have is no single task's. Texts are shuffled by document once to find passages.

Defined cases: null text has no words and stays null. Rows with the same doc_id are one document: all keep what they
own. A row without doc_id comes after all that have one, in the order of a hash of its text (ids of 2**62 and more count
as none); rows without one that have the same text all keep it, if no document owns it. Empty tables give empty
results. Extra columns pass through unchanged. A text is worked on in pieces, so its length is not limited by a task's
memory but for some 40 bytes a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.llm.common import SLICE_CHARS, guard, hashed_words, mix, powers, slices, stage
from quillspark.staging import forget, noted

MIN_WORDS, WIDTH, PAD, ROWS = 50, 20, 16, 100_000
#: Words at a passage's start whose hash may see what stands before it: those that end in its first 15 bytes.
BLURRED = 7
#: Ids from here on stand for rows without one.
NO_ID = 1 << 62
SPACED = re.compile(rb"[^ \t-\r]+")
GAP = re.compile(rb"[ \t-\r]")
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: 256 random values by the splitmix64 rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 16 bytes up to each position: h = (h << 1) + gear[byte], by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint32(k)
        h = h + older
    return h


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[bytes, bytes, np.ndarray]]:
    """(what stands before, bytes, ends of its texts): runs of texts, each text followed by ``PAD`` spaces, and long
    texts in pieces that end at white space."""
    held, ends, size = [], [], 0
    for t in texts:
        t = t or b""
        if len(t) <= SLICE_CHARS:
            held.append(t + b" " * PAD)
            size += len(held[-1])
            ends.append(size)
            if size < SLICE_CHARS:
                continue
        if held:
            yield b"", b"".join(held), np.array(ends)
            held, ends, size = [], [], 0
        if len(t) > SLICE_CHARS:
            at = 0
            while at < len(t):
                gap = GAP.search(t, at + SLICE_CHARS)
                to = gap.start() if gap else len(t)
                # Before a piece stands the end of the one before it, as words with one space between them.
                before = b" ".join((t[max(0, at - 64 * PAD) : at]).split())[-PAD:] + b" " if at else b""
                piece = t[at:to] + b" " * PAD
                yield before, piece, np.array([len(piece)] if to == len(t) else [], np.int64)
                at = to
    if held:
        yield b"", b"".join(held), np.array(ends)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text, hash of each word, gear hash at each word's end)."""
    n, hashes, gears = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    open_ = 0  # words of a text's earlier pieces
    for before, piece, ends in _pieces(texts):
        data = np.frombuffer(piece, np.uint8)
        space = _IS_SPACE[data]
        start, end, hash_ = hashed_words(data, space)
        of = np.searchsorted(start, ends)
        n += (np.diff(of, prepend=0) + np.append(open_, np.zeros(len(ends), np.int64))[: len(ends)]).tolist()
        open_ = 0 if len(ends) else open_ + len(start)
        if not len(start):
            continue
        hashes.append(hash_)
        # One space between words, and all of the padding that keeps a text's hashes from seeing the one before it.
        kept = ~(space & np.append(True, space[:-1]))
        for e in ends.tolist():
            kept[e - PAD : e] = True
        flat = np.where(space, np.uint8(32), data)[kept]
        first = np.frombuffer(before, np.uint8) if before else np.full(PAD, 32, np.uint8)
        gears.append(rolling(np.concatenate([first, flat]))[len(first) + np.cumsum(kept)[end] - 1])
    return np.array(n, np.int64), np.concatenate(hashes), np.concatenate(gears)


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of ``width`` neighbours, by doubling."""
    out, size = x, 1
    while 2 * size <= width:
        out, size = op(out[:-size], out[size:]), 2 * size
    return op(out[: len(x) - width + 1], out[width - size :][: len(x) - width + 1]) if size < width else out


class Chunks:
    """The chunks of a list of texts: ``doc``, ``start`` and ``end`` (words, counted over all texts) and ``digest``."""

    def __init__(self, texts: list[bytes | None], width: int = WIDTH) -> None:
        self.n, self.hash, gear = words(texts)
        self.ends = np.cumsum(self.n)
        doc, total = np.repeat(np.arange(len(self.n)), self.n), len(self.hash)
        cut = np.zeros(total, bool)
        if total >= width:
            h = gear.astype(np.int64)
            least = _sliding(np.minimum, h, width)
            least[doc[: len(least)] != doc[width - 1 :]] = -1  # no run of words goes over a text's end
            none = np.full(width - 1, -1)
            cut = _sliding(np.maximum, np.concatenate([none, least, none]), width) == h
        cut[self.ends[self.n > 0] - 1] = True
        self.end = np.flatnonzero(cut) + 1
        self.start = np.append(0, self.end[:-1])[: len(self.end)]
        self.doc = doc[self.start] if total else np.zeros(0, np.int64)
        value, self.back = self.hash * powers(total), powers(total, True)
        self.upto = np.append(np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64))
        self.digest = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the words of each run."""
        return mix((self.upto[end] - self.upto[start]) * self.back[start])

    def candidates(self, shared: np.ndarray, min_words: int, width: int = WIDTH) -> np.ndarray:
        """Places from which ``min_words`` words of one text may be another's too.

        The chunk of a word depends on no more than ``width`` words behind its start's hash and ``width`` from it on, so
        in words that two texts have in common the chunks of those in the middle are shared.
        """
        total = len(self.hash)
        unshared = np.append(0, np.cumsum(np.repeat(~shared, self.end - self.start)))
        fits = np.flatnonzero(np.repeat(self.ends, self.n) - np.arange(total) >= min_words)
        return fits[unshared[fits + min_words - width + 1] == unshared[fits + BLURRED + width]]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, a hash of the text, and _id: the row's id, or for none a number from ``NO_ID`` on."""
    key = F.xxhash64(F.col("text").cast("string"))
    none = key.bitwiseAND(F.lit(NO_ID - 1).cast("long")) + F.lit(NO_ID).cast("long")
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), none), "_key": key})


def chunk_table(docs: DataFrame, min_words: int, width: int) -> DataFrame:
    """A row (key, digest) for each distinct chunk of a text that has ``min_words`` words, and a row (key, id, n_words) for each row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                c = Chunks(texts, width)
                at = np.flatnonzero(c.n[c.doc] >= min_words)
                at = at[np.lexsort((c.digest[at], c.doc[at]))]
                new = np.append(True, (c.digest[at][1:] != c.digest[at][:-1]) | (c.doc[at][1:] != c.doc[at][:-1]))[: len(at)]
                at, ids, keys = at[new], part.column(0), part.column(1)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.nulls(len(keys), pa.int64()), ids, pa.array(c.n)], names=["key", "digest", "id", "n_words"]
                )
                for a in range(0, len(at), ROWS):
                    some = at[a : a + ROWS]
                    none = pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(c.doc[some])), pa.array(c.digest[some].view(np.int64)), none, none],
                        names=["key", "digest", "id", "n_words"],
                    )

    return docs.select("_id", "_key", "text").mapInArrow(each, "key long, digest long, id long, n_words long")


def shared_chunks(docs: DataFrame, min_words: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows, texts). rows: (key, id, n_words) of each row. texts: for each different text its key, the smallest id that
    has it (``owner``), the largest one, its words, and the digests that it shares with other texts."""
    table = stage(chunk_table(docs, min_words, width), "chunks")
    rows = table.where("id is not null").select("key", "id", "n_words")
    of = table.where("digest is not null").select("digest", "key")
    several = of.groupBy("digest").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one < other")
    several = stage(several.select("digest"), "shared")
    found = of.join(several, "digest").unionByName(rows, allowMissingColumns=True)
    texts = found.groupBy("key").agg(
        F.min("id").alias("owner"), F.max("id").alias("last"), F.max("n_words").alias("n_words"), F.collect_set("digest").alias("shared")
    )
    return rows, stage(texts.where("size(shared) > 0 or owner < last"), "texts")


def candidate_windows(docs: DataFrame, texts: DataFrame, min_words: int, width: int) -> DataFrame:
    """(window, id, key, place) of every candidate window of each text, as its owner has it."""
    asked = texts.where("size(shared) > 0").select(F.col("owner").alias("_id"), F.col("key").alias("_key"), "shared")
    # One plan at every size: the texts are shuffled once, unsorted.
    joined = docs.select("_id", "_key", "text").join(asked.hint("shuffle_hash"), ["_id", "_key"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts_ in slices(batch, "text"):
                c = Chunks(texts_, width)
                lists = part.column("shared")
                flat, off = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
                known = np.repeat(np.arange(len(texts_)), np.diff(off))
                salt = mix(np.arange(1, len(texts_) + 1, dtype=np.uint64))  # a digest counts for its own text only
                at = c.candidates(np.isin(c.digest ^ salt[c.doc], flat ^ salt[known]), min_words, width)
                doc = np.searchsorted(c.ends, at, side="right")
                for a in range(0, len(at), ROWS):
                    w, d = at[a : a + ROWS], doc[a : a + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c.hashes(w, w + min_words).view(np.int64)), part.column(0).take(pa.array(d)),
                            part.column(1).take(pa.array(d)), pa.array((w - (c.ends - c.n)[d]).astype(np.int32)),
                        ],
                        names=["window", "id", "key", "place"],
                    )

    return joined.select("_id", "_key", "text", "shared").mapInArrow(each, "window long, id long, key long, place int")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, width: int | None = None) -> DataFrame:
    """(_id, _key, _passages): of documents with any, an array of (first_word, end_word, owner_doc_id) in order.

    Words count from 0; owner_doc_id is the smallest one, null where the owner has none. ``width`` is at most what
    leaves a whole chunk in ``min_words`` words, (min_words - BLURRED) / 2.
    """
    width = width or max(1, min(WIDTH, (min_words - BLURRED) // 2))
    base = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    rows, texts = shared_chunks(base, min_words, width)
    windows = stage(candidate_windows(base, texts, min_words, width), "windows")
    owned = windows.groupBy("window").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last")
    owned = stage(owned.select("window", "owner"), "owned")
    repeats = windows.join(owned, "window").where("owner < id").select("id", "key", "place", "owner")
    # Repeats of one text that touch are a passage; a text's windows are one group, as its words are.
    w = W.partitionBy("id", "key").orderBy("place")
    new = F.coalesce(F.col("place") > F.lag("place").over(w) + min_words, F.lit(True)).cast("int")
    runs = repeats.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    found = runs.groupBy("id", "key", "run").agg(
        F.min("place").alias("first_word"), (F.max("place") + min_words).cast("int").alias("end_word"), F.min("owner").alias("owner")
    )
    whole = texts.where((F.col("owner") < F.col("last")) & (F.col("n_words") >= min_words)).select("key", "owner")
    copies = rows.join(whole, "key").where("owner < id").select(
        "id", "key", F.lit(0).alias("first_word"), F.col("n_words").cast("int").alias("end_word"), "owner"
    )
    owner = F.when(F.col("owner") < NO_ID, F.col("owner")).alias("owner_doc_id")
    listed = found.drop("run").union(copies.distinct()).groupBy(F.col("id").alias("_id"), F.col("key").alias("_key"))
    return listed.agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word", owner))).alias("_passages"))


def cut_out(text: str, found: list[tuple[int, int]]) -> str:
    """text without these runs of words, and without the white space before each."""
    data = text.encode()
    spans = [m.span() for m in SPACED.finditer(data)]
    out, at = [], 0
    for a, b in found:
        out.append(data[at : spans[a - 1][1] if a else 0])
        at = spans[b - 1][1]
    out.append(data[at:])
    return b"".join(out).decode()


def substring_dedup(docs: DataFrame, **how) -> DataFrame:
    """docs with repeated passages cut out of every text but their owner's; the columns stay. n_chars, if there, is
    the new text's length. A document of which nothing is left stays, with an empty text."""
    plain, back = guard(docs, ("doc_id", "text", "n_chars"))
    own: list = []
    with noted(own):
        found = repeated_passages(plain, **how)
    found = stage(found, "passages")
    forget(own)
    full = keyed(plain).join(found.hint("shuffle_hash"), ["_id", "_key"], "left").drop("_id", "_key")
    text_at, at = full.columns.index("text"), full.columns.index("_passages")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, texts = batch.column(at), batch.column(text_at)
            if hits.null_count < len(hits):
                new = [
                    cut_out(t, [(h["first_word"], h["end_word"]) for h in f]) if f else t
                    for t, f in zip(texts.to_pylist(), hits.to_pylist(), strict=True)
                ]
                texts = pa.array(new, pa.string())
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [texts if i == text_at else batch.column(i) for i in keep], names=[batch.schema.names[i] for i in keep]
            )

    out = full.mapInArrow(each, StructType([f for f in full.schema.fields if f.name != "_passages"]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return back(out)
