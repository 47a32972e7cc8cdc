"""Source divergence audit: how far the terms of each source of a language are from every other source's, exactly.

A group (lang, source) and each language give every kept term of the language a smoothed integer share
p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), where V terms are kept and N is the group's count over them.
The distance of two groups is the sum of abs(p - q) over all V terms, by inclusion and exclusion over their supports:

* every term as if neither group had it: V * abs(z - z'), with z the share of a term that a group hasn't: a constant;
* terms of one group as if the other had none: abs(p - z') - abs(z - z'), priced from the group's histogram of counts,
  since p depends on the count alone;
* terms of both: abs(p - q) - abs(p - z') - abs(z - q) + abs(z - z'), from a join of the sparse postings.

So no term that a pair of groups hasn't is ever looked at. Tasks count their own terms first (``counted``); postings of
terms in too few documents go before anything is joined. Sums stay within 64 bits, products are decimals.

Defined cases: null text, lang and source are empty. Every row is a document, repeated rows and ids included. A
language without kept terms has pairs of value 0 and no terms; a group without terms is compared like any other. Ties
rank by item. A language of one source has no pairs. Long texts are counted in pieces. Empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_CHARS, prepare, slices, stage

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50

#: Terms are runs of ASCII letters and of bytes of other code points: all other bytes become spaces, A-Z lower case.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries that a task counts before it sends them.
HELD = 200_000
COUNTED = "lang string, source string, term binary, n long, docs long"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_CHARS)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents, added up over what a task reads."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*g, t, n, docs[t]) for g, (terms, docs) in held.items() for t, n in terms.items()]
        held.clear()
        columns = list(zip(*rows, strict=True))
        types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part, texts in slices(batch, "text"):
            for lang, source, text in zip(part["lang"].to_pylist(), part["source"].to_pylist(), texts, strict=True):
                seen: set[bytes] = set()
                terms, docs = held.setdefault((lang, source), (Counter(), Counter()))
                for words in _pieces(text or b""):
                    terms.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(x[0]) for x in held.values()) >= HELD:
                yield flush()
    if any(x[0] for x in held.values()):
        yield flush()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, found) of each kept term: occurrences in the language, and source and n where there are any."""
    prepare(docs.sparkSession)
    # Dealt by language and term once; both sums stay where the rows are.
    counts = _named(docs).mapInArrow(counted, COUNTED).repartition("lang", "term")
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("found")
    )
    return lists.where(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "total", "found")


def _share(n: Column, size: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (n + prior) / size) of longs, without overflow; null where size is 0."""
    whole = F.call_function("div", (n + prior).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)"), F.nullif(size, F.lit(0)).cast("decimal(20,0)"))
    return whole + 1


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, prior: int = PRIOR, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group all other sources by distance (``pair``), and the ``top``
    terms by how far their share is above the language's (``term``)."""
    kept = stage(postings(docs, least_docs), "postings")
    entries = kept.select("lang", "term", "total", F.inline("found").alias("source", "n"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    of_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = _named(docs.withColumn("text", F.lit(""))).select("lang", "source").distinct()
    groups = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "group_n"])
    smooth = F.col("v") * prior
    groups = groups.select(
        "lang", "source", "v", (F.col("group_n") + smooth).alias("size"), (F.col("lang_n") + smooth).alias("lang_size")
    ).withColumn("z", F.coalesce(_share(F.lit(0), F.col("size"), prior, scale), F.lit(0)))
    groups = stage(groups, "groups")

    shares = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "z", _share(F.col("n"), F.col("size"), prior, scale).alias("p"),
        _share(F.col("total"), F.col("lang_size"), prior, scale).alias("q"),
    )
    shares = stage(shares, "shares")
    a, b = groups.select("lang", F.col("source").alias("a"), "v", F.col("z").alias("za")), groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    base = F.abs(F.col("za") - F.col("zb"))
    neither = a.join(b, "lang").where("a < b").select("lang", "a", "b", (F.col("v") * base).alias("value"))
    histogram = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("z").alias("za")).agg(F.count("*").alias("terms"))
    one = histogram.join(b, "lang").where("a <> b").select(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("terms") * (F.abs(F.col("p") - F.col("zb")) - base)).alias("value")
    )
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    seen_apart = F.abs(F.col("pa") - F.col("zb")) + F.abs(F.col("za") - F.col("pb"))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", (F.abs(F.col("pa") - F.col("pb")) - seen_apart + base).alias("value"))
    pairs = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = pairs.select("lang", F.inline(ways), F.lit("pair").alias("part"), "value")

    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
