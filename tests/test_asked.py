"""What is asked grows with the tables: every vector and every account whose key 20 divides."""

from quillspark.plans import QUERIES


def test_one_in_twenty_vectors_is_asked(spark, sf_dir):
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    assert {r.qid for r in QUERIES["vector_topk"](spark, sf_dir).collect()} == ids
    assert {r.qid for r in QUERIES["vector_topk_multi"](spark, sf_dir).collect()} == ids
    assert {r.name for r in QUERIES["entity_resolution"](spark, sf_dir).collect()} == ids
    assert {r.qid for r in QUERIES["semantic_cache"](spark, sf_dir).collect()} <= ids


def test_one_in_twenty_accounts_is_asked(spark, sf_dir):
    want = {r[0] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 20 = 0").select("c_custkey").collect()}
    keys = {r[0] for r in QUERIES["fraud_signals"](spark, sf_dir).select("qid").collect()}
    assert keys and keys <= want and len(keys) > len(want) / 2
    assert {int(r.account[1:]) for r in QUERIES["fraud_ring"](spark, sf_dir).select("account").collect()} <= want
