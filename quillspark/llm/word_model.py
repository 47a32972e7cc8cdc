"""An interpolated modified Kneser-Ney model over word n-grams, of an open vocabulary, with counts in shards.

Words are runs of letters, marks, digits and _, as written (no folding of case or script). Every other character that
isn't white space is a word of its own, and so is every letter of the scripts written without spaces. A word is held as
a 64-bit hash. Documents begin with ORDER - 1 START words and end with an END word.

Nothing of the model is gathered. A log probability is a sum of one value for each n-gram (0 for an unseen one):

    log p(abc) = value(abc) + value(bc) + value(c) + back(ab) + back(b)

where value(g) = log p(g) - log back(history of g) - log p(g less its first word) if g was seen, and back(h) is the log of
a seen history's back-off weight. So a document is scored by looking up each n-gram once, in any order. Tasks send the
distinct n-grams of a block of documents, sorted and packed, to the shards that hold the values; sums by document come back.

All of this is done in slices, so that what lies on disk at once is a part of the n-grams only: a slice has the trigrams of
a part of the middle words, with their histories ab and the pairs bc. ``count`` goes over the trusted texts for what all
slices need (counts of counts, each word's continuations and its sums as a history); ``values`` makes the model of one
slice, and ``log_perplexities`` adds it up over the documents. Within a slice the trigrams are dealt by ab and again by bc,
so a frequent word is no task's alone.

A document is never scored by a model that has read it: documents are dealt into two folds by id, and each fold is
scored by the model of the trusted documents of the other one (of all trusted documents, if a fold has none).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import slices, stage, unstage

ORDER = 3
START, END = 0x5354415254, 0x454E44
#: Values that a shard holds, about, and words whose n-grams a task combines before they are shuffled.
SHARD_VALUES, COMBINED = 4_000_000, 1_000_000
#: Trusted text of a training shard, in bytes, about.
SHARD_BYTES = 8 << 20
#: Slices of the passes that count and of those that score, at most, and bytes of text that are a slice of their own in
#: smaller corpora.
COUNT_SLICES, SLICES, SLICED_BYTES = 5, 10, 16 << 20
#: Bytes of documents that share one set of a model's shards.
SALT_BYTES = 4 << 30
#: Scripts without spaces between words: South-East Asian ones, kana and ideographs.
UNSPACED = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))
SPACE, WORD, ALONE = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15 | 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, ALONE, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            out[c] = SPACE
        elif ch.isalnum() or ch == "_" or unicodedata.category(ch)[0] == "M":
            out[c] = WORD
    for a, b in UNSPACED:
        part = out[a:b]
        part[part == WORD] = ALONE
    return out


@cache
def _coded() -> np.ndarray:
    """What a code point adds to a word's hash; 0 for white space."""
    return np.where(_classes() == SPACE, np.uint64(0), _mix(np.arange(1, 0x110001, dtype=np.uint64)))


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of each word of these texts, and each text's number of characters."""
    if all(t.isascii() for t in texts if t):
        whole = [np.frombuffer(t or b"", np.uint8) for t in texts]
    else:
        whole = [np.frombuffer((t or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    n = np.array([len(p) for p in whole], np.int64)
    points = np.concatenate(whole) if whole else np.zeros(0, np.uint32)
    kind = _classes()[points]
    before = np.empty_like(kind)
    before[:1], before[1:] = SPACE, kind[:-1]
    ends = np.cumsum(n)
    first = (ends - n)[n > 0]
    before[first] = SPACE
    at = np.flatnonzero((kind == ALONE) | ((kind == WORD) & (before != WORD)))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), n
    # A word is a polynomial in an odd base, of the places in it; white space after it adds nothing.
    size = np.diff(np.append(at, len(points)))
    place = np.arange(at[0], len(points)) - np.repeat(at, size)
    power = np.full(int(size.max()), _BASE, np.uint64)
    power[0] = 1
    value = _coded()[points[at[0] :]] * np.cumprod(power)[place]
    return np.searchsorted(ends, at, side="right"), _mix(np.add.reduceat(value, at - at[0])), n


def windows(doc: np.ndarray, word: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, place in it) of documents with words: the last START at place 0, the words, END."""
    n = np.bincount(doc, minlength=n_docs)
    own = np.flatnonzero(n)
    size = n[own] + 2
    out_doc = np.repeat(own, size)
    last = np.cumsum(size) - 1
    seq = np.zeros(len(out_doc), np.uint64)
    inner = np.ones(len(seq), bool)
    inner[last] = inner[last - size + 1] = False
    seq[inner], seq[last], seq[last - size + 1] = word, END, START
    return out_doc, seq, np.arange(len(seq)) - np.repeat(last - size + 1, size)


def sliced(word: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    """Whether these words are of slice part[0] of part[1]."""
    if part[1] == 1:
        return np.ones(len(word), bool)
    return (word >> np.uint64(32)) * np.uint64(part[1]) >> np.uint64(32) == part[0]


def trigrams(seq: np.ndarray, place: np.ndarray, part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(where, its last ORDER words, oldest first) at each word or END whose word before is of this slice."""
    at = np.flatnonzero(sliced(seq[:-1], part) & (place[1:] > 0)) + 1
    return at, np.array([np.where(place[at] > 1, seq[np.maximum(at - 2, 0)], np.uint64(START)), seq[at - 1], seq[at]])


def keys(fold: np.ndarray, w: np.ndarray, history: bool = False) -> np.ndarray:
    """The n-gram w (its words, oldest first) of a fold as one number; as a history of others it has another one."""
    x = _mix(fold.astype(np.uint64) + np.uint64(1 + 16 * len(w) + 8 * history))
    for row in w:
        x = _mix(x * np.uint64(_BASE) + row)
    return x


def _groups(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of (fold, words...), and of each row the number of its own."""
    key = keys(columns[0], columns[1:])
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in columns], of


def _distinct(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    columns, of = _groups(columns)
    return columns, np.bincount(of, n, len(columns[0])).astype(np.int64)


def _join(*columns: np.ndarray) -> bytes:
    return b"".join(_pack(c.view(np.uint64) if c.dtype == np.float64 else c) for c in columns)


def _split(payloads: list[bytes], reals: int, wholes: int) -> list[np.ndarray]:
    """The columns of these payloads, one after another: ``wholes`` whole numbers, then ``reals`` doubles."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(wholes + reals)]
    for b in payloads:
        at = 0
        for p in parts:
            x, at = _unpack(b, at)
            p.append(x)
    whole = [np.concatenate(p) for p in parts]
    return whole[:wholes] + [x.view(np.float64) for x in whole[wholes:]]


def _dealt(key: np.ndarray, bits: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """These columns' rows, packed by the shard of their keys."""
    order = np.argsort(key)
    for s, p in _parts(key[order], bits):
        yield s, _join(*(c[order[p]] for c in columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    """(shard, its rows by kind) of rows sorted by shard; kinds below 0 as they come, of shard -1."""
    shard, held = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] < 0:
                yield -1, {row["kind"]: [row]}
                continue
            if row["shard"] != shard:
                if held:
                    yield shard, held
                shard, held = row["shard"], {}
            held.setdefault(row["kind"], []).append(row)
    if held:
        yield shard, held


#: Packed rows between tasks: what they are, the shard they go to, the shard that asks, how many entries, the entries.
_SENT = "kind int, shard int, src int, n long, payload binary"
_SENT_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("src", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
VALUES, TRIGRAMS, ASKED, PAIRS, ANSWERS = -1, 1, 2, 3, 4


def _met(rows: DataFrame, bits: int) -> DataFrame:
    return rows.repartition(1 << bits, "shard").sortWithinPartitions("shard", "kind")


def _said(trusted: DataFrame, part: tuple[int, int], bits: int) -> DataFrame:
    """The slice's trigrams of docs (text, fold) with their counts, combined in each task, dealt by their first two words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            (fold, *w), n = _distinct([np.concatenate(c) for c in zip(*held, strict=True)], np.ones(size, np.int64))
            dealt = _dealt(keys(fold, w[:2], True), bits, fold, *w, n)
            return _batch([(TRIGRAMS, s, 0, 0, b) for s, b in dealt], _SENT_ARROW)

        for batch in batches:
            for piece, texts in slices(batch, "text"):
                folds = np.array(piece.column(1).to_pylist(), np.int32)
                doc, seq, place = windows(*words(texts)[:2], len(texts))
                at, w = trigrams(seq, place, part)
                held.append([folds[doc[at]], *w])
                size += len(at)
                if size >= COMBINED:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    made = trusted.select(F.col("text").cast("string").alias("text"), F.col("fold").cast("int")).mapInArrow(each, _SENT)
    return _met(made, bits)


def _trigrams(rows: dict[int, list]) -> tuple[list[np.ndarray], np.ndarray]:
    *gram, n = _split([r["payload"] for r in rows[TRIGRAMS]], 0, ORDER + 2)
    return _distinct(gram, n)


def _pair_counts(middle: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a trigram adds to the count of its last two words: one, or all its occurrences where the pair begins with START."""
    return np.where(middle == START, n, 1)


def count(trusted: DataFrame, part: tuple[int, int], bits: int) -> DataFrame:
    """(kind, fold, w, x1..x4) of one slice: of kind 0 how many n-grams of order w occur 1 to 4 times; of kind 1 how many
    different words follow w 1, 2 and more times and how many in all; of kind 2 how many different words come before w (x1)."""

    def by_history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _shards(batches):
            (fold, *w), n = _trigrams(rows)
            pairs, m = _distinct([fold, *w[1:]], _pair_counts(w[1], n))
            out = [(PAIRS, s, 0, 0, b) for s, b in _dealt(keys(pairs[0], pairs[1:]), bits, *pairs, m)]
            counted = [np.bincount(fold[n == k].astype(np.int64), minlength=2) for k in range(1, 5)]
            out += [(VALUES, 0, ORDER, f, np.array([c[f] for c in counted], np.int64).tobytes()) for f in (0, 1)]
            yield _batch(out, _SENT_ARROW)

    names = ["kind", "fold", "w", "x1", "x2", "x3", "x4"]

    def made(kind: int, fold: np.ndarray, w: np.ndarray, *x: np.ndarray) -> pa.RecordBatch:
        x = [np.asarray(c, np.int64) for c in x]
        columns = [pa.array(np.full(len(w), kind, np.int32)), pa.array(np.asarray(fold, np.int32)), pa.array(np.asarray(w, np.uint64).view(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c) for c in x), *(pa.array(np.zeros(len(w), np.int64)) for _ in range(4 - len(x)))], names=names)

    def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            if shard < 0:
                r = rows[VALUES][0]
                yield made(0, [r["n"]], [r["src"]], *np.frombuffer(r["payload"], np.int64)[:, None])
                continue
            (fold, b, c), n = _distinct(*(lambda x: (x[:3], x[3]))(_split([r["payload"] for r in rows[PAIRS]], 0, 4)))
            for f in (0, 1):
                yield made(0, [f], [2], *[[((n == k) & (fold == f)).sum()] for k in range(1, 5)])
            (of_fold, word), of = _groups([fold, b])
            yield made(1, of_fold, word, *[np.bincount(of, x, len(word)) for x in (n == 1, n == 2, n > 2, n)])
            yield made(2, *_groups_of([fold, c]))

    schema = "kind int, fold int, w long, x1 long, x2 long, x3 long, x4 long"
    out = _met(_said(trusted, part, bits).mapInArrow(by_history, _SENT), bits).mapInArrow(by_pair, schema)
    return out.groupBy("kind", "fold", "w").agg(*[F.sum(c).alias(c) for c in names[3:]])


def _groups_of(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    columns, n = _distinct(columns, np.ones(len(columns[0]), np.int64))
    return *columns, n


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """By Chen and Goodman from the counts of counts."""
    if not (n1 and n2):
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]


class Counted:
    """What all slices of a model need: each word's counts, a staged table, and by fold a few numbers."""

    def __init__(self, trusted: DataFrame) -> None:
        self.trusted = trusted
        size = trusted.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        n = min(COUNT_SLICES, 1 + size // SLICED_BYTES)
        self.size, self.bits = size, lambda n: max(4, int(size // n // SHARD_BYTES).bit_length())
        parts = [stage(count(trusted, (s, n), self.bits(n)), "words") for s in range(n)]
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        x = [F.sum(F.when(F.col("kind") == 1, F.col(f"x{i}")).otherwise(0)).alias(f"h{i}") for i in range(1, 5)]
        by_word = every.where("kind > 0").groupBy("fold", "w").agg(F.sum(F.when(F.col("kind") == 2, F.col("x1")).otherwise(0)).alias("n"), *x)
        self.words = stage(by_word, "words")
        counts: dict = {}
        for r in every.where("kind = 0").groupBy("fold", "w").agg(*[F.sum(f"x{i}") for i in range(1, 5)]).collect():
            counts.setdefault(r.fold, {})[r.w] = _discounts(*r[2:])
        for p in parts:
            unstage(p)
        self.discounts, self.low, self.total = {}, {}, {}
        more = [F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]
        for r in self.words.where("n > 0").groupBy("fold").agg(F.sum("n"), F.count("*"), *more).collect():
            fold, total, vocabulary, *n = r
            d = _discounts(*n)
            cut = d[0] * n[0] + d[1] * n[1] + d[2] * (vocabulary - n[0] - n[1])
            self.discounts[fold] = counts[fold] | {1: d}
            self.low[fold], self.total[fold] = cut / total / (vocabulary + 1), total

    def unknown(self) -> dict[int, float]:
        """By fold, log p of a word that it never read."""
        return {f: float(np.log(x)) for f, x in self.low.items()}


def _cut(discounts: dict, order: int, fold: np.ndarray, n: np.ndarray) -> np.ndarray:
    table = np.zeros((2, 4))
    for f, d in discounts.items():
        table[f, 1:] = d[order]
    return table[fold.astype(np.int64), np.minimum(n, 3).astype(np.int64)]


def values(counted: Counted, part: tuple[int, int]) -> DataFrame:
    """(n, payload): the values of one slice's n-grams by key, packed."""
    bits, discounts, low, total = counted.bits(part[1]), counted.discounts, counted.low, counted.total

    def packed(shard: int, key: np.ndarray, value: np.ndarray) -> tuple:
        return VALUES, shard, 0, len(key), key.tobytes() + value.astype(np.float32).tobytes()

    def by_history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            (fold, *w), n = _trigrams(rows)
            cut = _cut(discounts, ORDER, fold, n)
            history, of = _groups([fold, *w[:2]])
            every = np.bincount(of, n, len(history[0]))
            back = np.bincount(of, cut, len(history[0])) / every
            sent = _dealt(keys(fold, w[1:]), bits, fold, w[1], w[2], _pair_counts(w[1], n), keys(fold, w), (n - cut) / every[of], back[of])
            yield _batch([packed(shard, keys(history[0], history[1:], True), np.log(back)), *[(PAIRS, s, 0, 0, b) for s, b in sent]], _SENT_ARROW)

    def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            if shard < 0:
                yield _batch([tuple(rows[VALUES][0].values())], _SENT_ARROW)
                continue
            fold, b, c, m, key, own, back = _split([r["payload"] for r in rows[PAIRS]], 2, 5)
            pairs, of = _groups([fold, b, c])
            n = np.bincount(of, m, len(pairs[0])).astype(np.int64)
            (f, w), _ = _groups([np.tile(pairs[0], 2), np.concatenate(pairs[1:])])
            asked = [(ASKED, s, shard, 0, x) for s, x in _dealt(keys(f, [w]), bits, f, w)]
            yield _batch([(PAIRS, shard, 0, 0, _join(*pairs, n)), (TRIGRAMS, shard, 0, 0, _join(of, key, own, back)), *asked], _SENT_ARROW)

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, w = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().view(np.uint64)
            sent = _dealt(keys(fold, [w]), bits, fold, w, *(b.column(2 + i).to_numpy() for i in range(5)))
            yield _batch([(TRIGRAMS, s, 0, 0, x) for s, x in sent], _SENT_ARROW)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            fold, w, n, *h = _split([r["payload"] for r in rows.get(TRIGRAMS, [])], 0, 7)
            key = keys(fold, [w])
            order = np.argsort(key)
            key, fold, w, n, h = key[order], fold[order], w[order], n[order], [x[order] for x in h]
            lows, totals = (np.array([x.get(0, 1.0), x.get(1, 1.0)])[fold.astype(np.int64)] for x in (low, total))
            p = (n - _cut(discounts, 1, fold, n)) / totals + lows
            back = sum(h[i] * _cut(discounts, 2, fold, np.full(len(fold), i + 1)) for i in range(3)) / np.maximum(h[3], 1)
            mine = sliced(w, part)
            value = np.where(n > 0, np.log(p) - np.log(lows), 0) + np.where(h[3] > 0, np.log(np.where(h[3] > 0, back, 1)), 0)
            out = [packed(shard, key[mine], value[mine])]
            for r in rows.get(ASKED, []):
                f, x = _split([r["payload"]], 0, 2)
                asked = keys(f, [x])
                at = np.searchsorted(key, asked)
                out.append((ANSWERS, r["src"], 0, 0, _join(asked, p[at], h[3][at].astype(np.float64), back[at])))
            yield _batch(out, _SENT_ARROW)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            if shard < 0:
                yield _batch([tuple(rows[VALUES][0].values())], _SENT_ARROW)
                continue
            fold, b, c, n = _split([r["payload"] for r in rows[PAIRS]], 0, 4)
            of, key, own, before = _split([r["payload"] for r in rows[TRIGRAMS]], 2, 2)
            word, p1, every, back = _split([r["payload"] for r in rows[ANSWERS]], 3, 1)
            order = np.argsort(word)
            word = word[order]
            at = order[np.searchsorted(word, keys(fold, [b]))]
            every, back, p1 = every[at], back[at], p1[order[np.searchsorted(word, keys(fold, [c]))]]
            p2 = (n - _cut(discounts, 2, fold, n)) / every + back * p1
            of = of.astype(np.int64)
            yield _batch([packed(shard, keys(fold, [b, c]), np.log(p2) - np.log(back) - np.log(p1)), packed(shard, key, np.log(own + before * p2[of]) - np.log(before) - np.log(p2[of]))], _SENT_ARROW)

    first = stage(_met(_said(counted.trusted, part, bits).mapInArrow(by_history, _SENT), bits).mapInArrow(by_pair, _SENT), "pairs")
    of_words = counted.words.select("fold", "w", "n", "h1", "h2", "h3", "h4").mapInArrow(by_word, _SENT)
    answered = _met(of_words.union(first.where(F.col("kind") == ASKED)), bits).mapInArrow(answers, _SENT)
    second = _met(answered.union(first.where(F.col("kind").isin(PAIRS, TRIGRAMS))), bits).mapInArrow(settled, _SENT)
    out = stage(second.union(first.where(F.col("kind") == VALUES)).select("n", "payload"), "values")
    unstage(first)
    return out


def train(trusted: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """The values of all n-grams as one slice and, by fold, log p of a word that it never read."""
    counted = Counted(trusted)
    return values(counted, (0, 1)), counted.unknown()


def _pack(x: np.ndarray) -> bytes:
    """Non-negative numbers, in as few bytes each as the largest one needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + len(x).to_bytes(4, "little") + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(b: bytes, at: int) -> tuple[np.ndarray, int]:
    width, n = b[at], int.from_bytes(b[at + 1 : at + 5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8, n * width, at + 5).reshape(n, width)
    return out.view("<u8").ravel(), at + 5 + n * width


def _parts(key: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The shards of sorted keys: the values of their highest bits."""
    ends = np.searchsorted(key >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64), side="right")
    for s, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if b > a:
            yield s, slice(int(a), int(b))


def _totals(docs: DataFrame, model: DataFrame, unknown: dict[int, float], keep: list[str], salt_bytes: int, part: tuple[int, int]) -> DataFrame:
    """docs' columns ``keep`` with n_symbols, n_events and total, what a slice adds to the sum of log probabilities."""
    bits = max(4, int((model.agg(F.sum("n")).first()[0] or 0) // SHARD_VALUES).bit_length())
    # A shard's values meet the documents of one salt in a task, so tasks grow with the documents and with the model.
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    salts = 1 + int(size // salt_bytes)
    one = len(unknown) == 1
    kept = docs.select(*keep, F.col("fold").cast("int").alias("_fold"), F.col("text").cast("string").alias("_text"))
    meta = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2])
    sent = f"shard int, kind int, block long, idx int, payload binary, {meta}, n_symbols long, total double, n_events long"

    def held_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = np.frombuffer(payload, np.uint64, n)
                at = np.argsort(key)
                key, value = key[at], np.frombuffer(payload, np.float32, n, 8 * n)[at]
                rows = [(s, key[p].tobytes() + value[p].tobytes()) for s, p in _parts(key, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "payload"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        fields = None
        for batch in batches:
            for piece, texts in slices(batch, "_text", 4_000_000):
                folds = np.array(piece.column(len(keep)).to_pylist(), np.int64)
                folds = np.full(len(folds), next(iter(unknown))) if one else 1 - folds
                doc, word, n = words(texts)
                n_events = np.bincount(doc, minlength=len(texts))
                n_events += n_events > 0
                doc, seq, place = windows(doc, word, len(texts))
                own = np.flatnonzero(sliced(seq, part))
                at, w = trigrams(seq, place, part)
                fold, own_fold = folds[doc[at]], folds[doc[own]]
                key = np.concatenate([keys(own_fold, [seq[own]]), keys(fold, w[:2], True), keys(fold, w[1:]), keys(fold, w)])
                of = np.concatenate([doc[own], *[doc[at]] * 3])
                at = np.argsort(key, kind="stable")
                key, of = key[at], of[at]
                rows, salt = [], ((block + (block >> 32)) % salts) << bits
                for s, p in _parts(key, bits):
                    k, d = key[p], of[p]
                    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                    runs = np.diff(np.append(first, len(k)))
                    rows.append((s + salt, _pack(np.diff(k[first], prepend=np.uint64(0))) + _pack(runs) + _pack(d)))
                total = n_events * np.array([unknown[f] if part[0] == 0 else 0.0 for f in folds])
                none, m = [None] * len(texts), len(rows)
                spread = np.arange(len(texts)) % (salts << bits)
                if fields is None:
                    fields = piece.schema.names[: len(keep)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*spread.tolist(), *[r[0] for r in rows]], pa.int32()), pa.array([2] * len(texts) + [1] * m, pa.int32()),
                        pa.array([block] * (len(texts) + m), pa.int64()), pa.array([*range(len(texts)), *[None] * m], pa.int32()),
                        pa.array([*none, *[r[1] for r in rows]], pa.binary()),
                        *[pa.concat_arrays([piece.column(i), pa.nulls(m, piece.column(i).type)]) for i in range(len(keep))],
                        pa.array([*n.tolist(), *[None] * m], pa.int64()), pa.array([*total.tolist(), *[None] * m], pa.float64()),
                        pa.array([*n_events.tolist(), *[None] * m], pa.int64()),
                    ],
                    names=["shard", "kind", "block", "idx", "payload", *fields, "n_symbols", "total", "n_events"],
                )
                block += 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, table = None, [], None
        for batch in batches:
            passed = batch.filter(pa.compute.equal(batch.column(1), 2))
            if passed.num_rows:
                yield passed.select([2, 3, *range(5, len(batch.schema))])
            for row in batch.filter(pa.compute.less(batch.column(1), 2)).select([0, 1, 2, 4]).to_pylist():
                if row["shard"] != shard:
                    shard, held, table = row["shard"], [], None
                if not row["kind"]:
                    held.append(row["payload"])
                    continue
                if table is None:
                    n = [len(p) // 12 for p in held]
                    key = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(p, np.uint64, m) for p, m in zip(held, n, strict=True)]])
                    value = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(p, np.float32, m, 8 * m) for p, m in zip(held, n, strict=True)]])
                    at = np.argsort(key, kind="stable")
                    key, value = key[at], value[at].astype(np.float64)
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                    table, held = (key[first], np.add.reduceat(value, first) if len(first) else value), []
                asked, to = _unpack(row["payload"], 0)
                runs, to = _unpack(row["payload"], to)
                docs_, _ = _unpack(row["payload"], to)
                got = np.zeros(len(asked))
                if len(table[0]):
                    asked = np.cumsum(asked)
                    at = np.minimum(np.searchsorted(table[0], asked), len(table[0]) - 1)
                    got = np.where(table[0][at] == asked, table[1][at], 0.0)
                sums = np.bincount(docs_.astype(np.int64), weights=np.repeat(got, runs.astype(np.int64)))
                idx = np.flatnonzero(sums)
                empty = [pa.nulls(len(idx), batch.schema.field(5 + i).type) for i in range(len(keep) + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(idx), row["block"])), pa.array(idx.astype(np.int32)), *empty, pa.array(sums[idx]), pa.nulls(len(idx), pa.int64())],
                    names=["block", "idx", *batch.schema.names[5:]],
                )

    each_salt = model.mapInArrow(held_values, "shard int, payload binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = each_salt.select((F.col("shard") + F.col("salt") * (1 << bits)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("idx"), "payload")
    both = held.unionByName(kept.mapInArrow(grams, sent), allowMissingColumns=True)
    met = both.repartition(salts << bits, "shard").sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(look_up, f"block long, idx int, {meta}, n_symbols long, total double, n_events long")
    summed = found.groupBy("block", "idx").agg(*[F.max(c).alias(c) for c in [*keep, "n_symbols", "n_events"]], F.sum("total").alias("total"))
    return summed.select(*keep, "n_symbols", "n_events", "total")


def _per_word(sums: DataFrame, keep: list[str]) -> DataFrame:
    return sums.select(*keep, "n_symbols", F.when(F.col("n_events") > 0, -F.col("total") / F.col("n_events")).alias("log_perplexity"))


def log_perplexities(docs: DataFrame, model: DataFrame, unknown: dict[int, float], keep: list[str], salt_bytes: int = SALT_BYTES) -> DataFrame:
    """docs' columns ``keep`` with n_symbols and log_perplexity, by the model of the other fold than docs' own ``fold``.

    Null without words. A model of one fold scores both.
    """
    return _per_word(_totals(docs, model, unknown, keep, salt_bytes, (0, 1)), keep)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffled files go when the query that wrote them ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trusted_perplexities(docs: DataFrame, trusted: DataFrame, keep: list[str]) -> DataFrame | None:
    """``log_perplexities`` by the model of trusted (text, fold), slice after slice; None without trusted text.

    A slice's n-grams are deleted before the next one's are made. Equal rows of docs have equal sums, so the slices' sums
    are put together by the row and its text's hash, whatever order the rows are read in.
    """
    with _shuffles_dropped(docs.sparkSession):
        counted = Counted(trusted)
        unknown = counted.unknown()
        if not unknown:
            return None
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        n = min(SLICES, 1 + size // SLICED_BYTES)
        if n == 1:
            return log_perplexities(docs, values(counted, (0, 1)), unknown, keep)
        row = [*keep, "fold", "_text_hash"]
        rows, sums = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string"))), []
        for s in range(n):
            model = values(counted, (s, n))
            sums.append(stage(_totals(rows, model, unknown, row, SALT_BYTES, (s, n)), "sums"))
            unstage(model)
        unstage(counted.words)
    every = sums[0]
    for x in sums[1:]:
        every = every.union(x)
    copies = (F.count("*") / n).cast("long").alias("_copies")
    whole = every.groupBy(*row, "n_symbols", "n_events").agg(F.sum("total").alias("total"), copies)
    whole = whole.withColumn("total", F.col("total") / F.col("_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return _per_word(whole, keep)
