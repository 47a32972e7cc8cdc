"""Term statistics: sparse vectors, inverse document frequency, term-match and temporal scores (A1-A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.operators.ranking import distinct_rows, top_per
from quillspark.staging import stage, unstage


def sparse_vectors(pieces: DataFrame, key: list[str], text: str) -> DataFrame:
    """A1, A2: (key, idx, tf). Tokens are counted within the row's group before anything is shuffled."""
    tok = pieces.select(*key, F.explode(T.tokens(F.col(text))).alias("token"))
    return tok.select(*key, T.sparse_bin(F.col("token")).alias("idx")).groupBy(*key, "idx").agg(
        F.count("*").cast("double").alias("tf")
    )


def idf(postings: DataFrame, n: int | Column, key: str = "id", token: str = "token") -> DataFrame:
    """A3, M2: (token, df, idf) with idf = ln(N / df), from rows (id, token), as often as they are said."""
    n = F.lit(n) if isinstance(n, int) else n
    df = distinct_rows(postings.select(token, key)).groupBy(token).agg(F.count(key).alias("df"))
    return df.withColumn("idf", F.ln(n / F.col("df")))


def capped_postings(postings: DataFrame, n: int, queries: DataFrame, key: str = "id") -> DataFrame:
    """(qid, keyword, idf, id) for query keywords with a positive idf (of n); each keyword's first ids only.

    The postings (id, token) are first cut to the queries' keywords, a semi join before anything is counted or ranked,
    and staged: they are read for the counts and for the ids.
    """
    asked = queries.select(F.col("keyword").alias("token")).distinct()
    hit = stage(postings.join(asked, "token", "left_semi").select(F.col("token").alias("keyword"), key).distinct(), "postings")
    weights = idf(hit, n, key, "keyword").where("idf > 0").select("keyword", "idf")
    first = top_per(hit, ["keyword"], [F.col(key)], C.CONCEPTS_PER_KEYWORD, "_nth").drop("_nth")
    return queries.join(weights, "keyword").join(first, "keyword")


def capped_index(postings: DataFrame, n: int, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Staged (token, weight), the idf of each token where it is positive, and (key, tokens), each row's tokens of which it
    is among the first ids (L6): what many questions are asked of, made once from rows (key, token)."""
    hit = stage(distinct_rows(postings.select("token", key)), "postings")
    weights = stage(idf(hit, n, key).where("idf > 0").select("token", F.col("idf").alias("weight")), "weights")
    first = top_per(hit, ["token"], [F.col(key)], C.CONCEPTS_PER_KEYWORD, "_nth").groupBy(key).agg(F.collect_list("token").alias("tokens"))
    first = stage(first, "capped")
    unstage(hit)
    return weights, first


def term_scores(matched: DataFrame, weight: Column | None = None, key: str = "id") -> DataFrame:
    """A4: (qid, id, score, n_terms, terms) from rows (qid, keyword, idf, id); weight multiplies each idf (A5)."""
    w = F.col("idf") if weight is None else F.col("idf") * weight
    return matched.groupBy("qid", key).agg(
        F.sum(w).alias("score"),
        F.count("*").alias("n_terms"),
        F.array_sort(F.collect_list(F.struct("keyword", "idf"))).alias("terms"),
    )


def day_weight(nth: Column) -> Column:
    """By the day's position from 1; the last weight repeats."""
    return F.element_at(F.array(*map(F.lit, C.DAY_WEIGHTS)), F.least(nth, F.lit(len(C.DAY_WEIGHTS))).cast("int"))


def day_boost(score: Column, days: Column) -> Column:
    """M3: times days ** 1.5 beyond one day."""
    return F.when(days > 1, score * F.pow(days.cast("double"), F.lit(C.DAY_POWER))).otherwise(score)
