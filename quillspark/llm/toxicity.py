"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make the document's score.

Tokens are labelled from the labelled documents: a word or word beginning marks a token toxic where documents with it
are marked toxic significantly more often than others. On windows of these tokens a two-state chain is trained
(features: the word and its beginnings of three to seven characters, hashed to ``2 ** BITS`` weights; transitions).
Forward-backward over a whole text gives each token's marginal; their sum, maximum and density go into a logistic
layer fitted on the labelled documents. Offending offsets are the runs of tokens whose marginal is at least a half.

The fit uses at most ``MOST_DOCS`` labels, ``MOST_BYTES`` of their rows' text and ``MOST_WINDOWS`` windows, the first by
a hash of the id: those bounds are the parameters of a classifier's sample; scoring reads every text in whole. Only the text is a feature.

Defined cases: null or empty text scores as a text without tokens. Labels that are null, or of ids that no document
has, are not used; of contradictory labels of one id each counts once. Without both classes in the labels the score
is 0.0 for every text. Repeated rows score alike. Extra columns pass through unchanged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from quillspark.llm.common import free_name, guard, slices

BITS, WIDTH, MOST_DOCS, MOST_BYTES, MOST_WINDOWS, EPOCHS, THRESHOLD = 21, 32, 6_000, 64 << 20, 20_000, 5, 0.7
BEGINNINGS = (3, 4, 5, 6, 7)
TOKEN = re.compile(r"\w+")
N_FEATURES = 1 + len(BEGINNINGS)


def features(token: str) -> list[int]:
    """Weights a token adds up; weight 0 stands for a beginning the token is too short for."""
    mask = (1 << BITS) - 1
    out = [1 + zlib.crc32(token.encode()) % mask]
    n = len(token)
    for k in BEGINNINGS:
        out.append(1 + zlib.crc32(f"{k}^{token[:k]}".encode()) % mask if n > k else 0)
    return out


class Tagger:
    """The fitted chain and its logistic layer; a worker remembers the score of words it has seen."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, layer: np.ndarray | None) -> None:
        self.at = np.flatnonzero(weights).astype(np.int32)
        self.values = weights[self.at].astype(np.float32)
        self.bias, self.trans, self.layer = bias, trans, layer
        self._dense: np.ndarray | None = None
        self._seen: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None, "_seen": {}}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.values
        seen = self._seen
        if len(seen) > 100_000:
            seen.clear()
        new = [t for t in set(tokens) if t not in seen]
        if new:
            ids = np.array([features(t) for t in new], np.int64)
            seen.update(zip(new, (self._dense[ids].sum(axis=1) + self.bias).tolist(), strict=True))
        return np.fromiter(map(seen.__getitem__, tokens), np.float64, len(tokens))

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        return chain_marginals(e, first, self.trans)

    def score(self, summary: np.ndarray) -> np.ndarray:
        if self.layer is None:
            return np.zeros(len(summary))
        return 1 / (1 + np.exp(-np.clip(summary @ self.layer, -30, 30)))


def chain_marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(state 1) at each token of chains laid end to end; first: where a chain begins. Exact, in square-root blocks.

    e: the emission's log odds of state 1. trans: 2 x 2 log potentials. A chain's beginning forgets what is before.
    """
    n = len(e)
    if not n:
        return np.zeros(0)
    size = max(1, int(np.sqrt(n)))
    columns = -(-n // size)
    pad = size * columns - n
    odds = np.exp(np.clip(np.concatenate((e, np.zeros(pad))), -25, 25)).reshape(columns, size).T.copy()
    new = np.concatenate((first, np.ones(pad, bool))).reshape(columns, size).T.copy()
    t = np.exp(trans)
    t00, t01, t10, t11 = (np.where(new, 1.0, x) for x in t.ravel())
    t01, t11 = t01 * odds, t11 * odds
    a, b, c, d = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
    for k in range(size):  # each column's product of matrices
        a, b = a * t00[k] + b * t10[k], a * t01[k] + b * t11[k]
        c, d = c * t00[k] + d * t10[k], c * t01[k] + d * t11[k]
        norm = 1 / (a + b + c + d)
        a, b, c, d = a * norm, b * norm, c * norm, d * norm
    f0, f1 = np.empty(columns), np.empty(columns)
    x, y = 0.5, 0.5
    for j, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        f0[j], f1[j] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    b0, b1 = np.empty(columns), np.empty(columns)
    x, y = 0.5, 0.5
    for j in range(columns - 1, -1, -1):
        b0[j], b1[j] = x, y
        x, y = a[j] * x + b[j] * y, c[j] * x + d[j] * y
        x, y = x / (x + y), y / (x + y)
    fwd = np.empty((size, columns))
    one = np.empty((size, columns))
    for k in range(size):
        f0, f1 = f0 * t00[k] + f1 * t10[k], f0 * t01[k] + f1 * t11[k]
        norm = 1 / (f0 + f1)
        f0, f1 = f0 * norm, f1 * norm
        fwd[k] = f1
    for k in range(size - 1, -1, -1):
        up = fwd[k] * b1
        one[k] = up / (up + (1 - fwd[k]) * b0)
        b0, b1 = t00[k] * b0 + t01[k] * b1, t10[k] * b0 + t11[k] * b1
        norm = 1 / (b0 + b1)
        b0, b1 = b0 * norm, b1 * norm
    return one.T.ravel()[:n]


def summaries(tagger: Tagger, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """For each text what the logistic layer reads, and (text number, marginals) of those with an offending token."""
    tokens, n = [], []
    for t in texts:
        found = TOKEN.findall(t.lower()) if t else []
        tokens += found
        n.append(len(found))
    counts = np.array(n, np.int64)
    ends = np.cumsum(counts)
    first = np.zeros(len(tokens), bool)
    first[(ends - counts)[counts > 0]] = True
    p = tagger.marginals(tagger.emissions(tokens), first)
    out = np.zeros((len(texts), 4))
    out[:, 0] = 1
    if len(p):
        has = counts > 0
        starts = (ends - counts)[has]
        out[has, 1] = np.log1p(np.add.reduceat(p, starts))
        out[has, 2] = np.maximum.reduceat(p, starts)
        out[has, 3] = np.log1p(100 * np.add.reduceat(p, starts) / counts[has])
    hot = np.unique(np.searchsorted(ends, np.flatnonzero(p >= 0.5), side="right"))
    return out, [(int(d), p[ends[d] - counts[d] : ends[d]]) for d in hot]


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of offending tokens: offsets in the text's code points, and the largest marginal."""
    out: list[dict] = []
    lowered = text.lower()
    shifted = len(lowered) != len(text)  # a few characters grow when lower-cased; then offsets are counted anew
    at = {}
    if shifted:
        grown = np.cumsum([0, *(len(c.lower()) for c in text)])
        at = lambda i: int(np.searchsorted(grown, i, side="right") - 1)
    hot = p >= 0.5
    open_ = False
    for m, h, x in zip(TOKEN.finditer(lowered), hot.tolist(), p.tolist(), strict=True):
        if h:
            start, end = (at(m.start()), at(m.end() - 1) + 1) if shifted else m.span()
            if open_:
                out[-1]["end"], out[-1]["marginal"] = end, max(out[-1]["marginal"], x)
            else:
                out.append({"start": start, "end": end, "marginal": x})
        open_ = h
    return out


def _marking(docs: list[np.ndarray], of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features that mark toxic tokens: their documents are toxic far more often than the base rate (log odds of the
    data under their own rate against the base rate of at least 11.5) and mostly. of: each word's features."""
    tox, all_ = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for ids, label in zip(docs, y, strict=True):
        u = np.unique(of[np.unique(ids)])
        all_[u] += 1
        if label:
            tox[u] += 1
    base = max(y.mean(), 1e-6)
    rate = tox / np.maximum(all_, 1)
    non = all_ - tox
    gain = tox * np.log(np.maximum(rate, 1e-12) / base) + non * np.log(np.maximum(1 - rate, 1e-12) / max(1 - base, 1e-6))
    mark = (tox >= 4) & (rate >= 0.6) & (gain >= 11.5)
    mark[0] = False
    return mark


def fit(texts: list[str | None], labels: list[int]) -> Tagger:
    """The tagger of labelled texts."""
    y = np.array(labels, np.int64)
    weights, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    if not len(y) or y.min() == y.max():
        return Tagger(weights, 0.0, trans, None)
    number: dict[str, int] = {}
    feats, rows = [], []
    for t in texts:
        toks = TOKEN.findall(t.lower()) if t else []
        new = [w for w in dict.fromkeys(toks) if w not in number]
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        feats.append(np.array([features(w) for w in new], np.int32).reshape(-1, N_FEATURES))
        rows.append(np.fromiter(map(number.__getitem__, toks), np.int32, len(toks)))
    number.clear()
    of = np.concatenate(feats)
    del feats
    mark = _marking(rows, of, y)
    toxic_word = mark[of].any(axis=1)
    with_, without = [], []
    for d, (ids, label) in enumerate(zip(rows, y.tolist(), strict=True)):
        tag = toxic_word[ids] & bool(label)
        for s in range(0, len(ids), WIDTH):
            (with_ if tag[s : s + WIDTH].any() else without).append((zlib.crc32(b"%d %d" % (d, s)), d, s))
    with_ = sorted(with_)[: MOST_WINDOWS // 3]
    chosen = sorted(with_ + sorted(without)[: MOST_WINDOWS - len(with_)])
    n = len(chosen)
    ids = np.zeros((n, WIDTH, N_FEATURES), np.int32)
    tag, real = np.zeros((n, WIDTH)), np.zeros((n, WIDTH), bool)
    for i, (_, d, s) in enumerate(chosen):
        w = rows[d][s : s + WIDTH]
        ids[i, : len(w)], tag[i, : len(w)], real[i, : len(w)] = of[w], toxic_word[w] & bool(y[d]), True
    del with_, without, chosen, rows, of
    # The windows' own features, numbered anew (weight 0 stays the first): no step looks at the others.
    used, ids = np.unique(np.append(ids.ravel(), 0), return_inverse=True)
    ids = ids[:-1].reshape(n, WIDTH, N_FEATURES)
    own = np.zeros(len(used))
    common = np.bincount(ids.ravel(), minlength=len(used)) >= 3
    common[0] = False
    bias, square, square_b, square_t = -2.0, np.full(len(used), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    for _ in range(EPOCHS):
        for s in range(0, n, 256):
            x, z, on = ids[s : s + 256], tag[s : s + 256], real[s : s + 256]
            first = np.zeros(on.shape, bool)
            first[:, 0] = True
            e = np.where(on, own[x].sum(axis=2) + bias, 0.0)
            flat = on.ravel()
            p, pair = _expect(e, on, first, trans)
            err = np.where(on, p - z, 0.0)
            g = np.bincount(x[on].ravel(), np.repeat(err.ravel()[flat], N_FEATURES), minlength=len(used))
            g = np.where(common, g, 0.0) / len(x) + 1e-5 * own
            square += g * g
            own -= 0.3 * g / np.sqrt(square)
            gb = err.sum() / len(x)
            square_b += gb * gb
            bias -= 0.3 * gb / np.sqrt(square_b)
            before, after, both = z[:, :-1], z[:, 1:], on[:, 1:]
            real_pairs = np.array(
                [[(both * (1 - before) * (1 - after)).sum(), (both * (1 - before) * after).sum()], [(both * before * (1 - after)).sum(), (both * before * after).sum()]]
            )
            gt = (pair - real_pairs) / len(x) + 1e-3 * trans
            square_t += gt * gt
            trans = trans - 0.3 * gt / np.sqrt(square_t)
    weights[used] = np.where(np.abs(own) < 1e-3, 0, own)
    tagger = Tagger(weights, float(bias), trans, None)
    parts, held, size = [], [], 0
    for t in [*texts, None]:
        held.append(t)
        size += len(t or "")
        if size > 2_000_000:
            parts.append(summaries(tagger, held)[0])
            held, size = [], 0
    parts.append(summaries(tagger, held)[0])
    tagger.layer = logistic(np.concatenate(parts)[: len(y)], y)
    return tagger


def _expect(e: np.ndarray, on: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of windows side by side, and the expected number of each pair of neighbouring states."""
    n, width = e.shape
    odds, t = np.exp(np.clip(e, -25, 25)), np.exp(trans)
    f = np.empty((width, n, 2))
    now = np.stack((np.ones(n), odds[:, 0]), axis=1)
    f[0] = now = now / now.sum(axis=1, keepdims=True)
    for k in range(1, width):
        now = now @ t
        now[:, 1] *= odds[:, k]
        f[k] = now = now / now.sum(axis=1, keepdims=True)
    p, pair = np.empty((n, width)), np.zeros((2, 2))
    back = np.ones((n, 2))
    for k in range(width - 1, -1, -1):
        both = f[k] * back
        p[:, k] = both[:, 1] / both.sum(axis=1)
        if k:
            right = back.copy()
            right[:, 1] *= odds[:, k]
            right[~on[:, k]] = 1.0
            joint = f[k - 1][:, :, None] * t[None] * right[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pair += joint[on[:, k]].sum(axis=0)
            back = np.where(on[:, k][:, None], right @ t.T, 1.0)
            back /= back.sum(axis=1, keepdims=True)
    return p, pair


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(text, toxic) of at most ``most`` labels outside the held-out fold, the first by a hash of the id. Of the rows
    that have those ids (an id may have several) the first ``2 * most`` are taken (equal ones count as one), and of these
    as many as have ``most_bytes`` of text together.

    The labels are cut first and then sizes, so only the chosen documents' texts are gathered.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    ranked = (
        labels.where("toxic is not null and doc_id is not null")
        .where(fold != 1)
        .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(most)
    )
    ranked = F.broadcast(ranked)  # at most ``most`` rows of two numbers
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ranked, "doc_id")
    texts = texts.withColumns({"_bytes": F.coalesce(F.octet_length("text"), F.lit(0)), "_hash": F.xxhash64("text")})
    # Sizes first: no task orders texts, and what goes over the bound is never gathered.
    key = ["doc_id", "toxic", "_bytes", "_hash"]
    order = [F.xxhash64("doc_id"), *key]
    sizes = texts.groupBy(*key).agg((F.col("_bytes") * F.count("*")).cast("long").alias("_all")).orderBy(*order).limit(2 * most)
    upto = F.sum("_all").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    few = sizes.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).select(*key)
    return texts.join(F.broadcast(few), key, "left_semi").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> Tagger:
    rows = training_rows(docs, labels, most, most_bytes).select("text", "toxic").toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())


def score_toxicity(docs: DataFrame, tagger: Tagger, out_score: str = "score", out_spans: str | None = "spans") -> DataFrame:
    """docs with the score and, if named, the offending spans (start, end, marginal) of each text. A name that docs has
    already gets ``_1`` and so on at its end."""
    out_score = free_name(docs, out_score)
    out_spans = free_name(docs, out_spans) if out_spans else None
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text", 500_000):
                strs = [t.decode("utf-8", "replace") if t is not None else None for t in texts]
                summary, hot = summaries(model, strs)
                columns = [*part.columns, pa.array(model.score(summary))]
                names = [*part.schema.names, out_score]
                if out_spans:
                    found: list = [[]] * len(strs)
                    for d, p in hot:
                        found[d] = spans(strs[d], p)
                    columns.append(pa.array(found, kind))
                    names.append(out_spans)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [*docs.schema.fields, StructField(out_score, DoubleType())]
    if out_spans:
        span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("marginal", DoubleType())])
        fields.append(StructField(out_spans, ArrayType(span)))
    return docs.mapInArrow(each, StructType(fields))


def reject_toxic(docs: DataFrame, tagger: Tagger, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents whose score reaches the threshold; their columns may have any name."""
    plain, back = guard(docs, ("text",))
    return back(score_toxicity(plain, tagger, "_score", None).where(F.col("_score") < threshold))
