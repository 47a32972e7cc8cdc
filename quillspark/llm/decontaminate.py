"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all terms of the training documents, once: the index is partitioned by document
(as search engines do it), one row per block of documents, with each term's sorted positions in that block. The test
windows go to every block; there the offset-adjusted lists are intersected from the window's rarest term on, rarity
being the term's count over the whole corpus. No posting list crosses a partition, so a term or a passage that a third
of all documents have is spread over all blocks.

The benchmark is the stated query set. Its windows are taken in blocks of about ``block_windows``, one after another:
each is small enough to send to every task, and freed before the next one comes. Of each what is found is staged, a row
for a document that is hit; rows of one document are united at the end, so the benchmark's size is not limited.

Terms are known by 64-bit hashes. Defined cases: null or empty text has no words, is never hit and never contaminated;
an item without words has no window. Repeated windows count once; repeated item ids are one item. A null item_id is not
listed in items_sha256 but its windows hit. Repeated doc_ids stay separate rows. A very long text is a block of its own.
Extra columns are passed through by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quillspark.llm.common import guard, hashed_words, slices, stage
from quillspark.staging import forget, noted

WINDOW, BLOCK_WINDOWS, BLOCK_BYTES = 13, 200_000, 1_500_000
#: Anchors that ``match`` holds at once.
ANCHORS = 1_000_000
#: A-Z to lower case; all bytes but digits, letters and those of non-ASCII characters to a space.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, hash of each word of all)."""
    parts = [(t or b"").translate(TABLE) + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    start, _, terms = hashed_words(data, data == 32)
    upto = np.searchsorted(start, np.cumsum([len(p) for p in parts]))
    return np.diff(upto, prepend=0), terms


class Windows:
    """A block of the benchmark's windows. terms: sorted hashes; rows: windows of ``size`` places in terms, -1 beyond a
    short item's end; items: for each window the ids of its items."""

    def __init__(self, rows: list[tuple], size: int) -> None:
        n, all_ = hashed([t for _, t in rows])
        self.terms, place = np.unique(all_, return_inverse=True)
        found: dict[tuple, set] = {}
        at = 0
        for (item, _), m in zip(rows, n.tolist(), strict=True):
            ids = place[at : at + m].tolist()
            at += m
            for i in range(max(1, m - size + 1) if m else 0):
                w = ids[i : i + size]
                found.setdefault((*w, *[-1] * (size - len(w))), set()).add(item)
        self.size = size
        self.rows = np.array(list(found), np.int32).reshape(-1, size)
        self.items = [sorted(x for x in v if x is not None) for v in found.values()]
        self.lengths = (self.rows >= 0).sum(axis=1)
        self.order = np.argsort(self.rows, axis=1)

    def met(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the sorted hashes ``terms``, own places) of the terms that both have."""
        at = np.searchsorted(terms, self.terms)
        own = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == self.terms) if len(terms) else np.zeros(0, np.int64)
        return at[own], own

    def by_rarity(self, counts: dict[int, int]) -> None:
        """Offsets of each window's terms, the corpus's rarest first; those beyond a short item's end come last."""
        df = np.array([counts.get(i, 0) for i in range(len(self.terms))] or [0], np.int64)
        cost = np.where(self.rows >= 0, df[self.rows], np.iinfo(np.int64).max)
        self.order = np.argsort(cost, axis=1, kind="stable")


def benchmark_blocks(items: DataFrame, size: int, block_windows: int) -> Iterator[Windows]:
    """The benchmark in blocks of whole items, each collected by itself."""
    held, n = [], 0
    local = items.select(F.col("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    for item, text in local.toLocalIterator(prefetchPartitions=False):
        text = bytes(text) if text is not None else None
        m = len((text or b"").translate(TABLE).split())
        if held and n + m > block_windows:
            yield Windows(held, size)
            held, n = [], 0
        held.append((item, text))
        n += m
    yield Windows(held, size)


def build_index(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The positional index of docs: a row (block, kept, n_words, terms, counts, positions) for a block of documents.

    terms: sorted hashes (64 bits); counts: of each (32 bits); positions: the block's words count one after another, and
    terms[0]'s positions come first, each as the difference from the one before it (32 bits). keep: columns that are
    carried in the block (as Arrow), such as an id or a hash.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in slices(batch, "text", BLOCK_BYTES):
                n, all_ = hashed(texts)
                order = np.argsort(all_, kind="stable").astype(np.int32)
                terms, counts = np.unique(all_, return_counts=True)
                rows = pa.ipc.new_stream(sink := pa.BufferOutputStream(), part.select(keep).schema)
                rows.write_batch(part.select(keep))
                rows.close()
                packed = [terms.tobytes(), counts.astype(np.int32).tobytes(), np.diff(order, prepend=np.int32(0)).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([n.tolist()], pa.list_(pa.int64()))]
                    + [pa.array([p], pa.binary()) for p in packed],
                    names=["block", "kept", "n_words", "terms", "counts", "positions"],
                )
                block += 1

    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(
        each, "block long, kept binary, n_words array<bigint>, terms binary, counts binary, positions binary"
    )


def _numbers(column: pa.Array, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def corpus_counts(index: DataFrame, windows: Windows) -> dict[int, int]:
    """How often the corpus has each of the windows' terms, by place."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, own = shared.value.met(_numbers(batch.column(0), i, np.uint64))
                total[own] += _numbers(batch.column(1), i, np.int32)[at]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    counted = index.select("terms", "counts").mapInArrow(each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = {r.term: r.n for r in counted.collect()}  # one row for each term of this block of windows
    shared.destroy()
    return out


def match(windows: Windows, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all occurrences in a block; start counts the block's words. terms: places in the windows'
    terms, rising, with their counts and positions.

    slop 0: the exact phrase. Else proximity: the rarest term anchors the window and every other one stands within
    ``slop`` words of its place, all in one document.
    """
    none = np.zeros(0, np.int64)
    total = int(n.sum())
    if not len(positions) or not len(windows.rows):
        return none, none
    starts = np.zeros(len(windows.terms) + 1, np.int64)
    starts[terms + 1] = counts
    starts = np.cumsum(starts)
    at = np.full(total, -1, np.int32)  # the lists, addressed by position
    at[positions] = np.repeat(terms, counts)
    doc = np.repeat(np.arange(len(n)), n)
    first = windows.order[:, 0]
    rarest = windows.rows[np.arange(len(first)), first]
    many = starts[rarest + 1] - starts[rarest]
    out = [
        _occurrences(windows, w, first, positions[starts[rarest[w]] + nth].astype(np.int64), at, doc, slop) for w, nth in _anchors(many)
    ]
    w, start = (np.concatenate([none, *x]) for x in zip(*out, strict=True)) if out else (none, none)
    return w, start


def _anchors(many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, number of the anchor) of each window's ``many`` anchors, in runs of ``ANCHORS`` at most."""
    ends = np.cumsum(many)
    for a in range(0, int(ends[-1]) if len(ends) else 0, ANCHORS):
        at = np.arange(a, min(a + ANCHORS, int(ends[-1])))
        w = np.searchsorted(ends, at, side="right")
        yield w, at - (ends - many)[w]


def _occurrences(windows: Windows, w: np.ndarray, first: np.ndarray, anchor: np.ndarray, at: np.ndarray, doc: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows w with an anchor each those that occur there, with their starts; at: the term at each position."""
    none, total = np.zeros(0, np.int64), len(at)
    start = anchor - first[w]
    for k in range(1, windows.size):
        if not len(w):
            return none, none
        offset = windows.order[w, k]
        term = windows.rows[w, offset]
        ok = term < 0
        for d in range(-slop, slop + 1):
            p = start + offset + d
            inside = (p >= 0) & (p < total)
            q = np.where(inside, p, 0)
            ok |= inside & (at[q] == term) & (doc[q] == doc[anchor])
        w, start, anchor = w[ok], start[ok], anchor[ok]
    if not slop:
        ok = (start >= 0) & (doc[np.maximum(start, 0)] == doc[anchor])
        w, start = w[ok], start[ok]
    return w, start


def hits(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """(block, doc, hit, items) of each document that is hit: its number in the block, the positions of its words inside
    an occurrence, and the items that occur."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                n = np.array(batch.column(1)[i].as_py(), np.int64)
                at, own = win.met(_numbers(batch.column(2), i, np.uint64))
                counts = _numbers(batch.column(3), i, np.int32).astype(np.int64)
                first = np.append(0, np.cumsum(counts))
                positions = np.cumsum(_numbers(batch.column(4), i, np.int32))
                inside = np.zeros(len(positions) + 1, np.int32)
                np.add.at(inside, first[at], 1)
                np.add.at(inside, first[at + 1], -1)
                w, start = match(win, n, own, counts[at], positions[np.cumsum(inside)[:-1] > 0], slop)
                if not len(w):
                    continue
                ends = np.cumsum(n)
                low, base = np.maximum(start, 0), ends - n
                doc = np.searchsorted(ends, low, side="right")
                low, high = np.maximum(low, base[doc]), np.minimum(start + win.lengths[w], ends[doc])
                hit = np.zeros(int(n.sum()) + 1, np.int64)
                np.add.at(hit, low, 1)
                np.add.at(hit, high, -1)
                on = np.flatnonzero(np.cumsum(hit)[:-1] > 0)
                each_doc = np.searchsorted(ends, on, side="right")
                items_of: dict[int, set] = {int(d): set() for d in np.unique(each_doc)}
                for d, x in set(zip(doc.tolist(), w.tolist(), strict=True)):
                    items_of[d].update(win.items[x])
                docs = sorted(items_of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * len(docs), pa.int64()), pa.array(docs, pa.int64()),
                        pa.array([(on[each_doc == d] - base[d]).tolist() for d in docs], pa.list_(pa.int64())),
                        pa.array([sorted(items_of[d]) for d in docs], pa.list_(pa.int64())),
                    ],
                    names=["block", "doc", "hit", "items"],
                )

    found = index.select("block", "n_words", "terms", "counts", "positions")
    out = stage(found.mapInArrow(each, "block long, doc long, hit array<bigint>, items array<bigint>"), "hits")
    shared.destroy()
    return out


def _with_hits(index: DataFrame, found: DataFrame, kept: StructType) -> DataFrame:
    """Each document's kept columns with _n_words, _hit and _items, from the rows of a block's documents that are hit.

    Those rows are staged, so that Spark knows their size: few of them are sent to the blocks, and texts stay in place.
    """
    per = stage(found.groupBy("block").agg(F.collect_list(F.struct("doc", "hit", "items")).alias("found")), "found")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, n, rows_of = (batch.column(j)[i] for j in range(3))
                n = n.as_py()
                hit: list[set] = [set() for _ in n]
                items: list[set] = [set() for _ in n]
                for x in rows_of.as_py() or ():
                    hit[x["doc"]].update(x["hit"])
                    items[x["doc"]].update(x["items"])
                rows = pa.ipc.open_stream(held.as_buffer()).read_next_batch()
                longs = pa.list_(pa.int64())
                more = [pa.array(n, pa.int64()), pa.array([sorted(x) for x in hit], longs), pa.array([sorted(x) for x in items], longs)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, "_n_words", "_hit", "_items"])

    longs = ArrayType(LongType())
    more = [StructField("_n_words", LongType()), StructField("_hit", longs), StructField("_items", longs)]
    joined = index.select("block", "kept", "n_words").join(per, "block", "left")
    return joined.select("kept", "n_words", "found").mapInArrow(each, StructType([*kept.fields, *more]))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], size: int = WINDOW, block_windows: int = BLOCK_WINDOWS, slop: int = 0) -> DataFrame:
    """docs' columns ``keep`` with _n_words, _n_hit, _n_items, _items_sha256, _contaminated.

    Contaminated: at least one word is hit, and a twentieth of all.
    """
    index = stage(build_index(docs, keep), "postings")
    parts = []
    for windows in benchmark_blocks(items, size, block_windows):
        windows.by_rarity(corpus_counts(index, windows))
        parts.append(hits(index, windows, slop))
    found = reduce(DataFrame.unionByName, parts)
    out = _with_hits(index, found, docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    n_hit = F.size("_hit").cast("long")
    listed = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        "_n_words",
        n_hit.alias("_n_hit"),
        F.size("_items").cast("long").alias("_n_items"),
        F.sha2(listed, 256).alias("_items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("_n_words"))).alias("_contaminated"),
    )


def item_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the contaminated documents.

    A text decides, so the index carries two hashes of it, and the documents themselves stay where they are: they meet the
    hashes of contaminated texts, which Spark sends to them while these are few. The index is dropped before that.
    """
    plain, back = guard(docs, ("text",))
    text = F.col("text").cast("string")
    marked = plain.withColumns({"_h": F.xxhash64(text), "_g": F.xxhash64(F.lit(1), text)})
    own: list = []
    with noted(own):
        found = contamination(marked, items, ["_h", "_g"], size).where("_contaminated").select("_h", "_g")
    found = stage(found.distinct(), "contaminated")
    forget(own)
    return back(marked.join(found, ["_h", "_g"], "left_anti"))
