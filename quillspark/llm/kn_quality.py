"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model trained on trusted text.

The n-grams are of words, three at most, of an open vocabulary, with counts in shards (``word_model``).

A document's perplexity is exp of its mean negative log probability per word (its end is one). A document is kept when
its perplexity is not above the quantile ``QUANTILE`` of the perplexities of the trusted documents of its language and
length class (all of them, to a precision of ``STEP`` in log perplexity). A group of under ``LEAST`` trusted documents
takes the quantile of its length class in all languages, else of its language, else of all.

Defined cases: text that is null or without words has no perplexity (null) and is not kept. A null lang is a language of
its own. Labels of unknown ids are not used; a document with labels of both kinds is trusted. Repeated rows count and
score each. Without trusted text nothing has a perplexity and nothing is kept. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import word_model as words
from quillspark.llm.common import stage

QUANTILE, STEP, LEAST, LENGTHS = 0.99, 1e-4, 20, (64, 256)


def length_class(n: Column) -> Column:
    """Very short texts vary much more: 0 under 64 symbols, 1 under 256, else 2."""
    return F.when(n < LENGTHS[0], 0).when(n < LENGTHS[1], 1).otherwise(2)


def thresholds(scored: DataFrame, by: list[str], quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """(by..., limit) from trusted documents' log_perplexity, for groups of ``least`` documents at least.

    A histogram of steps of ``STEP``, so each group's rows are counts and no group is gathered.
    """
    bins = scored.where("log_perplexity is not null").withColumn("bin", F.ceil(F.col("log_perplexity") / STEP))
    counts = bins.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    reached = upto.where((F.col("upto") >= F.col("total") * quantile) & (F.col("total") >= least))
    return reached.groupBy(*by).agg((F.min("bin") * STEP).alias("limit"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, trusted, kept). Trusted: labelled of quality 1."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    half = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("fold")), F.lit(2)).cast("int")
    base = base.withColumn("fold", half)
    # Read once a slice; Spark sends the trusted ids to the texts, up to its own limit for that.
    scored = words.trusted_perplexities(base, base.join(good, "doc_id", "left_semi"), ["doc_id", "lang"])
    if scored is None:
        scored = base.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("log_perplexity"))
    scored = scored.withColumn("length", length_class(F.col("n_symbols")))
    scored = stage(scored.join(good.withColumn("_good", F.lit(True)), "doc_id", "left"), "scored")
    trusted = scored.where("_good")
    fine = stage(thresholds(trusted, ["lang", "length"], quantile), "limits")
    coarse = stage(thresholds(trusted, ["lang"], quantile), "limits")
    by_length = {r.length: r.limit for r in thresholds(trusted, ["length"], quantile).collect()}  # three rows at most
    whole = thresholds(trusted.withColumn("all", F.lit(0)), ["all"], quantile, 1).first()
    f = fine.select(F.col("lang").alias("_f"), F.col("length").alias("_n"), F.col("limit").alias("_fine"))
    c = coarse.select(F.col("lang").alias("_c"), F.col("limit").alias("_coarse"))
    out = scored.join(f, scored["lang"].eqNullSafe(f["_f"]) & (scored["length"] == f["_n"]), "left")
    out = out.join(c, out["lang"].eqNullSafe(c["_c"]), "left")
    any_language = F.lit(None).cast("double")
    for n, x in by_length.items():
        any_language = F.when(F.col("length") == n, x).otherwise(any_language)
    limit = F.coalesce("_fine", any_language, "_coarse", F.lit(whole["limit"] if whole else None).cast("double"))
    return out.select(
        "doc_id", "lang", "n_symbols", F.exp("log_perplexity").alias("perplexity"), F.exp(limit).alias("threshold"),
        F.coalesce("_good", F.lit(False)).alias("trusted"),
        F.coalesce(F.col("log_perplexity") <= limit, F.lit(False)).alias("kept"),
    )
