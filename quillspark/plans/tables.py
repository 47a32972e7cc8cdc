"""Queries that call the table functions from SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import tables
from quillspark.plans import retrieval, text  # noqa: F401  (text registers the chunkers' SQL)
from quillspark.plans.registry import ORACLE, query, sents, table


@query(ORACLE["chunk_fixed"])
def sql_chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, CAST(c.chunk_idx AS BIGINT) AS chunk_idx, c.chunk FROM {docs} d, LATERAL fixed_chunks(d.text, 128, 16) c", docs=docs)


@query(ORACLE["chunk_words"])
def sql_chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables.register(spark)
    return spark.sql("SELECT d.doc_id, CAST(c.chunk_idx AS BIGINT) AS chunk_idx, c.chunk FROM {docs} d, LATERAL word_windows(d.text) c", docs=docs)


@query(f"SELECT lang, count(*) AS n_sentences, max(length(s)) AS longest FROM (SELECT lang, unnest({sents('text')}) AS s FROM documents) GROUP BY 1")
def sql_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tables.register(spark)
    return spark.sql("SELECT d.lang, count(*) AS n_sentences, CAST(max(length(c.chunk)) AS BIGINT) AS longest FROM {docs} d, LATERAL sentence_rows(d.text) c GROUP BY d.lang", docs=docs)


@query(f"WITH {retrieval._POOL}, {retrieval._RANKED} SELECT qid, doc_id, dual, score, rank FROM k")
def sql_ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    boost = F.when(F.col("dual"), C.DUAL_BOOST).otherwise(0.0) + F.when(F.col("doc_type") == "graph_edge", C.EDGE_BOOST).otherwise(0.0)
    score = F.round(F.when(F.col("signal") == "graph", 0.4).otherwise(0.1) + boost, 6)
    pool = retrieval._pool(spark, sf_dir).select("qid", "doc_id", "dual", "arrival", score.alias("score"))
    tables.register(spark)
    return spark.sql("SELECT qid, doc_id, dual, score, rank FROM ranked_hits(TABLE({pool}), 6)", pool=pool)


@query(
    """
    SELECT c_custkey, fact, weight, rank FROM customer JOIN (
        SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS fact, CAST(o_totalprice AS DOUBLE) AS weight,
            row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DOUBLE) DESC, CAST(o_orderkey AS VARCHAR)) AS rank FROM orders
    ) ON o_custkey = c_custkey WHERE c_custkey % 20 = 0 AND rank <= 3
    """
)
def sql_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of every customer whose key 20 divides, by a retriever that SQL calls."""
    facts = table(spark, sf_dir, "orders").selectExpr("string(o_custkey) AS subject", "string(o_orderkey) AS fact", "o_totalprice AS weight")
    name = f"orders_of_{uuid4().hex}"
    tables.register_retriever(spark, name, facts, 3)
    asked = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0")
    out = spark.sql(f"SELECT q.c_custkey, f.* FROM {{asked}} q, LATERAL {name}(string(q.c_custkey)) f", asked=asked)
    tables.drop_retriever(spark, name)
    return out
