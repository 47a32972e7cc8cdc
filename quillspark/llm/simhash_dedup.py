"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. Two fingerprints that differ in at most three bits have a half in
which they differ in at most one, so one of its 32 one-wildcard variants (the half without bit i) is equal. Each
distinct fingerprint therefore gets 64 keys; an equality grouping on the key finds every candidate, and the Hamming
distance verifies it. A key with more fingerprints than ``MOST`` is cut again by variants of the other half's
quarters, then eighths: what is left has at most 2 * 2 * 2 * 256 = 2048 different fingerprints, so no bucket is
unbounded and none is cut short.

Only the links a component needs leave a bucket (a forest, not all pairs); copies are folded into their fingerprint
before anything is compared.

Defined cases: null or empty text, or text without words, has fingerprint zero and links with others of that
fingerprint or near it. Rows with the same doc_id are one document to the links, each keeps its own fingerprint. A
null doc_id is carried, belongs to its fingerprint's component and never names one, unless all its ids are null:
then component_id is null. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, guard, slices, stage, unstage
from quillspark.staging import forget, noted

SEED, DISTANCE, MOST = 42, 3, 2048


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text in UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        shingles = [line[a : b - 1] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                fp = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, fp long"
    )


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, rest): for each fingerprint the one-wildcard variants of its low half, then of its high half.

    A key is the half without bit i, with i above it and the half's number above that; rest: where the other half
    begins.
    """
    bit = np.arange(32, dtype=np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys = []
        for half in (0, 1):
            value = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            kept = value[:, None] & ~(np.uint64(1) << bit)[None, :]
            keys.append(kept | (bit << np.uint64(32))[None, :] | np.uint64(half << 40))
        key = np.concatenate(keys, axis=1).ravel().view(np.int64)
        rest = np.tile(np.repeat(np.array([32, 0], np.int64), 32), len(fp))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(np.repeat(fp.view(np.int64), 64)), pa.array(rest)], names=["key", "fp", "rest"]
        )


def _deeper(key: np.ndarray, fp: np.ndarray, rest: np.ndarray, bits: int) -> tuple:
    """Keys of the next level, for fingerprints of buckets that are too large: variants of both halves of the ``bits``
    unused bits, which begin at ``rest``."""
    out_k, out_f, out_r = [], [], []
    half = bits // 2
    for part in range(2):
        start = rest + np.uint64(part * half)
        value = (fp >> start) & np.uint64((1 << half) - 1)
        for i in range(half):
            kept = value & ~np.uint64(1 << i)
            mixed = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64(part * 64 + i + 1) << np.uint64(48)) ^ kept
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out_k.append(mixed ^ (mixed >> np.uint64(32)))
            out_f.append(fp)
            out_r.append(rest + np.uint64((1 - part) * half))
    return np.concatenate(out_k), np.concatenate(out_f), np.concatenate(out_r)


def forest(fp: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For distinct fingerprints of one bucket: the index of each one's component within it."""
    rows = [np.bitwise_count(fp[a : a + 256, None] ^ fp[None, :]) <= distance for a in range(0, len(fp), 256)]
    label = np.arange(len(fp), dtype=np.int32)
    while True:
        new = np.concatenate([np.where(near, label[None, :], len(fp)).min(axis=1) for near in rows]).astype(np.int32)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _buckets(level: int, distance: int, most: int):
    """A mapInArrow function over rows (key, fp, rest) sorted by key: links, and the rows of too large buckets."""
    bits = 32 >> level

    def links(key: np.ndarray, fp: np.ndarray, rest: np.ndarray) -> Iterator[tuple]:
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        count = ends - starts
        pairs = starts[count == 2]
        a, b = fp[pairs], fp[pairs + 1] if len(pairs) else fp[:0]
        ok = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        yield 0, a[ok], b[ok], None
        for s, e in zip(starts[count > 2].tolist(), ends[count > 2].tolist(), strict=True):
            own = np.unique(fp[s:e])
            if len(own) > most and level < 2:
                yield 1, own, key[s], rest[s]
                continue
            label = forest(own, distance)
            moved = label != np.arange(len(own))
            yield 0, own[moved], own[label[moved]], None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.uint64)] * 3
        flooded: np.uint64 | None = None  # the key of a bucket of which a part has gone to the next level

        def out(parts) -> Iterator[pa.RecordBatch]:
            a, b, k = [], [], []
            for kind, *x in parts:
                if kind == 0:
                    a.append(x[0]), b.append(x[1])
                    k.append(np.full(len(x[0]), -1, np.int64))
                else:
                    own, key, rest = x
                    nk, nf, nr = _deeper(np.full(len(own), key), own, np.full(len(own), rest), bits)
                    a.append(nf), b.append(nk)
                    k.append(nr.astype(np.int64))
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64)), pa.array(np.concatenate(k))],
                    names=["a", "b", "rest"],
                )

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(3)]
            now = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(now[0]):
                continue
            if flooded is not None:
                n = int(np.searchsorted(now[0] != flooded, True))
                if n:
                    yield from out([(1, np.unique(now[1][:n]), flooded, now[2][0])])
                    now = [x[n:] for x in now]
                if not len(now[0]):
                    held = now
                    continue
                flooded = None
            last = int(np.flatnonzero(now[0] == now[0][-1])[0])  # the last bucket may go on in the next batch
            if len(now[0]) - last > 4 * most and level < 2:
                yield from out(links(*(x[:last] for x in now)))
                flooded = now[0][-1]
                yield from out([(1, np.unique(now[1][last:]), flooded, now[2][-1])])
                held = [x[:0] for x in now]
                continue
            yield from out(links(*(x[:last] for x in now)))
            held = [x[last:] for x in now]
        if len(held[0]):
            yield from out(links(*held))

    return each


def fingerprint_links(reps: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp): enough links to connect all that differ in ``distance`` bits.

    Two halves suffice for a distance of at most three.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard bit cover at most three differing bits")
    # Dealt out first: a task makes 64 rows of each of its fingerprints.
    keyed = reps.select("fp").repartition("fp").mapInArrow(variants, "key long, fp long, rest long")
    found = None
    for level in range(3):
        step = stage(
            keyed.repartition("key").sortWithinPartitions("key").mapInArrow(
                _buckets(level, distance, most), "a long, b long, rest long"
            ),
            "simhash",
        )
        links = step.where("rest < 0").select("a", "b")
        found = links if found is None else found.union(links)
        over = step.where("rest >= 0")
        if over.isEmpty():
            break
        keyed = over.select(F.col("b").alias("key"), F.col("a").alias("fp"), "rest")
    return found


def simhash_components(docs: DataFrame, width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of ``distance`` bits reach."""
    fps = stage(fingerprints(docs, width), "fps")
    reps = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    cc = connected_components(fingerprint_links(reps, distance))
    linked = reps.join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stage(linked.join(smallest, "component").select("fp", "component_id"), "named")
    unstage(reps)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, width: int = 3, distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id. Rows with a null id can't be told apart by it
    and stay. Of repeated rows of one id, one stays (the smallest text)."""
    docs, back = guard(docs, ("doc_id", "text"))
    own: list = []
    with noted(own):
        found = simhash_components(docs, width, distance)
    kept = stage(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("_n")), "kept")
    forget(own)
    # By one plan at every size: the texts are shuffled once, unsorted, beside the kept ids.
    once = docs.join(kept.where("_n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    once = once.union(docs.where("doc_id is null"))
    again = stage(kept.where("_n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return back(once)
    # Repeated ids: these rows only are grouped, by id and in whole.
    rest = docs.join(again, "doc_id", "left_semi").select(docs.columns)
    plain = [c for c in docs.columns if c not in ("doc_id",)]
    first = rest.groupBy("doc_id").agg(F.min(F.struct("text", *[F.col(c) for c in plain if c != "text"])).alias("_r"))
    return back(once.unionByName(first.select("doc_id", *[F.col(f"_r.{c}") for c in plain]).select(docs.columns)))
