"""The flagship query: questions to ranked chunks, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.search import term_top_k
from quillspark.plans.registry import query, sents, table, tok


@query(
    f"""
    WITH c AS (SELECT doc_id, unnest(l) AS chunk, unnest(range(0, len(l))) AS chunk_idx FROM (SELECT doc_id, {sents("text")} AS l FROM documents)),
    t AS (SELECT doc_id, chunk_idx, unnest({tok("chunk")}) AS token FROM c), tf AS (SELECT doc_id, chunk_idx, token, count(*) AS tf FROM t GROUP BY 1, 2, 3),
    df AS (SELECT token, count(DISTINCT doc_id) AS df FROM tf GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
    q AS (SELECT DISTINCT item_id AS qid, unnest({tok("text")}) AS token FROM benchmark),
    s AS (SELECT qid, doc_id, chunk_idx, round(sum(tf * ln(n / df)), 6) AS score FROM q JOIN df USING (token) JOIN tf USING (token), n GROUP BY 1, 2, 3)
    SELECT qid, doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_idx) AS rank FROM s QUALIFY rank <= 10
    """
)
def ranked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence chunks scored by sum of tf times idf over each benchmark item's tokens; the ten best of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text").dropDuplicates(["qid"])
    pieces = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("chunk_idx", "text"))
    pieces = pieces.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))
    return term_top_k(asked, pieces, 10, docs.count()).withColumn("rank", F.col("rank").cast("long"))
