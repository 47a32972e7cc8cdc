"""Fusion of several signals' records into one ranked, cited list.

Records are (qid, signal, arrival, text, doc_id, doc_type, concept_id); all of a batch of queries are fused at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.operators.ranking import first_per

RECORD = ["qid", "signal", "arrival", "text", "doc_id", "doc_type", "concept_id"]


def union_signals(*signals: DataFrame) -> DataFrame:
    """One list; columns a signal lacks are null, and arrivals are numbered signal by signal."""
    ready = [s.withColumn("_order", F.lit(i)) for i, s in enumerate(signals)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready)
    for c in RECORD:
        if c not in both.columns:
            both = both.withColumn(c, F.lit(None).cast("string"))
    w = W.partitionBy("qid").orderBy("_order", "arrival", "doc_id", "text")
    return both.withColumn("arrival", F.row_number().over(w)).drop("_order")


def dedupe(records: DataFrame) -> DataFrame:
    """The first of each (doc_id, text)."""
    return first_per(records, ["qid", "doc_id", "text"], [F.col("arrival")])


def dual_flags(records: DataFrame) -> DataFrame:
    """With ``dual``: another signal has the same concept, or a title that contains this one's or is contained.

    A query's distinct titles are one small array (its pool is bounded by the retrievers' k).
    """
    named = records.withColumn("_name", T.normal_name(F.col("text")))
    seen = named.groupBy("qid").agg(
        F.collect_set(F.struct("signal", F.col("_name").alias("name"))).alias("_names"),
        F.collect_set(F.when(F.col("concept_id").isNotNull(), F.struct("signal", F.col("concept_id").alias("cid")))).alias("_cids"),
    )
    full = named.join(seen, "qid")
    other = lambda x: ~x["signal"].eqNullSafe(F.col("signal"))
    by_id = F.exists("_cids", lambda x: other(x) & (x["cid"] == F.col("concept_id")))
    by_name = F.exists(
        "_names", lambda x: other(x) & (x["name"] != "") & (F.contains(x["name"], F.col("_name")) | F.contains(F.col("_name"), x["name"]))
    )
    dual = (F.col("_name") != "") & (F.coalesce(by_id, F.lit(False)) | F.coalesce(by_name, F.lit(False)))
    return full.withColumn("dual", dual).drop("_name", "_names", "_cids")


def only_dual(records: DataFrame) -> DataFrame:
    """F8: dual records only, but all where a query has none."""
    any_ = F.max("dual").over(W.partitionBy("qid"))
    return records.withColumn("_any", any_).where("dual or not _any").drop("_any")


def ranked(records: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Score (0 without a reranker) and boosts, falling, then arrival; confidence of the score itself."""
    raw = F.lit(0.0) if score is None else score
    boost = F.when(F.col("dual"), C.DUAL_BOOST).otherwise(0.0) + F.when(F.col("doc_type") == "graph_edge", C.EDGE_BOOST).otherwise(0.0)
    full = records.withColumn("raw", raw).withColumn("score", F.round(F.col("raw") + boost, 6))
    w = W.partitionBy("qid").orderBy(F.col("score").desc(), "arrival")
    return (
        full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .withColumn("confidence", T.confidence(F.col("score") - F.when(F.col("dual"), C.DUAL_BOOST).otherwise(0.0)))
        .drop("raw")
    )


def floor(rows: DataFrame, least: str) -> DataFrame:
    """rows at or above a confidence, ranked anew; all where none is."""
    level = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    bar = {"low": 0, "medium": 1, "high": 2}[least]
    full = rows.withColumn("_ok", level >= bar).withColumn("_any", F.max("_ok").over(W.partitionBy("qid")))
    kept = full.where("_ok or not _any").drop("_ok", "_any")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank")))


def bibliography(rows: DataFrame) -> DataFrame:
    """One source for each document by its first rank, with running reference numbers."""
    key = F.when(F.coalesce("doc_id", F.lit("")) == "", "__graph__").otherwise(F.col("doc_id"))
    first = first_per(rows.withColumn("source", key), ["qid", "source"], [F.col("rank")])
    return first.withColumn("ref", F.row_number().over(W.partitionBy("qid").orderBy("rank")))


def answer(rows: DataFrame, queries: DataFrame, synthesise) -> DataFrame:
    """R10's end: (qid, contexts, answer) with contexts in rank order; synthesis reads the first four, cut short."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    got = rows.groupBy("qid").agg(ordered.alias("contexts"))
    full = queries.select("qid", F.col("text").alias("query")).join(got, "qid", "left")
    full = full.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    read = F.transform(F.slice("contexts", 1, C.SYNTHESIS_CONTEXTS), lambda c: F.left(c, F.lit(C.SYNTHESIS_CONTEXT_CHARS)))
    return full.withColumn("answer", synthesise(F.col("query"), read))
