"""Search over sparse vectors by an impact-ordered inverted index (A2, L1).

A list holds the postings (id, tf) of one bin of one collection, largest tf first, in blocks with their largest tf as
bound. A search adds weight times tf over the bins that a query and a vector share. It reads:

1. the first block of each of a query's lists. The best of what they hold are scored exactly; the k-th score is a
   threshold that the result can't fall below;
2. blocks that can still hold a result. Lists whose bounds together stay below the threshold are left out whole, the
   longest for their bound first: a vector in these alone can't reach it. Of the others, a block is left out when its
   bound with the bounds of all other lists stays below;
3. the vectors found there, as far as their sum and the bounds of what was left out reach the threshold, to score them
   exactly.

So the result is exact, ties included (a vector is left out only if it is strictly worse), and a common bin's list is
read as far as it matters. All steps are joins by bin or id and sums; a hot list is many blocks, never one row or task.

Defined cases: weights and tf that are null or not positive don't count; vectors and queries without bins find nothing;
repeated (query, bin) and (id, bin) rows are added up; rows without a collection, id or bin are in no list. Fewer than k hits in a collection: all of them, and no block is
left out. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.staging import stage

#: Postings of a block at most, a power of two; how many times k are scored for the threshold.
BLOCK, HEADS = 64, 4


@dataclass(frozen=True)
class SparseIndex:
    """Three tables: blocks (coll, idx, block, bound, n, postings), lists (coll, idx, top, head, n) and vectors (coll, id, bins)."""

    blocks: DataFrame
    lists: DataFrame
    vectors: DataFrame


def build_index(vectors: DataFrame, block: int = BLOCK) -> SparseIndex:
    """The index of rows (coll, id, idx, tf); id may be a struct."""
    rows = vectors.where("tf > 0").groupBy("coll", "id", "idx").agg(F.sum("tf").cast("double").alias("tf"))
    rows = stage(rows, "bins")
    order = ["coll", "idx", F.desc("tf"), "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # Rows of a partition are numbered in order, with the partition in the upper bits: no block reaches over two.
    ranged = ranged.withColumn("block", F.floor(F.monotonically_increasing_id() / block))
    blocks = ranged.groupBy("coll", "idx", "block").agg(
        F.max("tf").alias("bound"), F.count("*").alias("n"), F.collect_list(F.struct("id", "tf")).alias("postings")
    )
    blocks = stage(blocks.sortWithinPartitions("coll", "idx", "block"), "blocks")
    lists = blocks.groupBy("coll", "idx").agg(F.max("bound").alias("top"), F.min("block").alias("head"), F.sum("n").alias("n"))
    whole = rows.groupBy("coll", "id").agg(F.sort_array(F.collect_list(F.struct("idx", "tf"))).alias("bins"))
    return SparseIndex(blocks, stage(lists, "lists"), stage(whole, "vectors"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("weight > 0").groupBy("qid", "idx").agg(F.sum("weight").cast("double").alias("weight"))


def _exact(found: DataFrame, asked: DataFrame, index: SparseIndex, decimals: int) -> DataFrame:
    """(qid, coll, id, score) of rows (qid, coll, id): the whole sum."""
    sought = asked.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("idx", "weight"))).alias("sought"))
    both = found.select("qid", "coll", "id").join(index.vectors, ["coll", "id"]).join(sought, "qid")
    zero = F.lit(0.0)
    score = F.aggregate("bins", zero, lambda s, x: s + x["tf"] * F.coalesce(F.try_element_at("sought", x["idx"]), zero))
    return both.select("qid", "coll", "id", F.round(score, decimals).alias("score"))


def _needed(asked: DataFrame, index: SparseIndex, k: int, decimals: int) -> DataFrame:
    """(qid, coll, weight, least, skipped, n, postings) of the blocks that can hold one of the k best.

    least: what a score must reach (null: anything); skipped: the bounds of the lists that are left out whole.
    """
    terms = asked.join(index.lists, "idx").select("qid", "coll", "idx", "weight", (F.col("weight") * F.col("top")).alias("most"), "head", "n")
    terms = stage(terms, "terms")
    heads = terms.join(index.blocks.drop("n"), ["coll", "idx"]).where("block = head").select("qid", "coll", "weight", F.inline("postings"))
    some = heads.groupBy("qid", "coll", "id").agg(F.sum(F.col("weight") * F.col("tf")).alias("part"))
    best = W.partitionBy("qid", "coll").orderBy(F.desc("part"), "id")
    some = some.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= HEADS * k)
    worth = W.partitionBy("qid", "coll").orderBy(F.desc("score"), "id")
    kth = _exact(some, asked, index, decimals).withColumn("nth", F.row_number().over(worth)).where(F.col("nth") == k)
    # Scores are rounded before they are ranked, and sums may differ in their last bits.
    least = (F.col("score") * (1 - 1e-9) - F.lit(10.0**-decimals)).alias("least")
    bounded = terms.join(kth.select("qid", "coll", least), ["qid", "coll"], "left")
    all_ = W.partitionBy("qid", "coll")
    upto = F.sum("most").over(all_.orderBy(F.col("most") / F.col("n"), "idx").rowsBetween(W.unboundedPreceding, W.currentRow))
    bounded = bounded.withColumns({"upto": upto, "rest": F.sum("most").over(all_) - F.col("most")})
    out = F.coalesce(F.col("upto") < F.col("least"), F.lit(False))
    bounded = bounded.withColumn("out", out).withColumn("skipped", F.sum(F.when(F.col("out"), F.col("most")).otherwise(0.0)).over(all_))
    reaches = F.col("least").isNull() | (F.col("weight") * F.col("bound") + F.col("rest") >= F.col("least"))
    lists = bounded.where(~F.col("out")).select("qid", "coll", "idx", "weight", "rest", "least", "skipped")
    return lists.join(index.blocks, ["coll", "idx"]).where(reaches).select("qid", "coll", "weight", "least", "skipped", "n", "postings")


def sparse_top_k(queries: DataFrame, index: SparseIndex, k: int, decimals: int = 6) -> DataFrame:
    """(qid, coll, id, score, rank): of each collection the k best of each query, from rows (qid, idx, weight)."""
    asked = stage(_asked(queries), "asked")
    postings = _needed(asked, index, k, decimals).select("qid", "coll", "weight", "least", "skipped", F.inline("postings"))
    found = postings.groupBy("qid", "coll", "id", "least", "skipped").agg(F.sum(F.col("weight") * F.col("tf")).alias("part"))
    found = found.where(F.col("least").isNull() | (F.col("part") + F.col("skipped") >= F.col("least")))
    w = W.partitionBy("qid", "coll").orderBy(F.desc("score"), "id")
    exact = _exact(found, asked, index, decimals)
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def postings_read(queries: DataFrame, index: SparseIndex, k: int, decimals: int = 6) -> DataFrame:
    """(qid, coll, n_read, n_all): postings in the blocks that step 2 of a search reads, and in all of the query's lists."""
    asked = stage(_asked(queries), "asked")
    read = _needed(asked, index, k, decimals).groupBy("qid", "coll").agg(F.sum("n").alias("n_read"))
    every = asked.join(index.lists, "idx").groupBy("qid", "coll").agg(F.sum("n").alias("n_all"))
    return every.join(read, ["qid", "coll"], "left").select("qid", "coll", F.coalesce("n_read", F.lit(0)).alias("n_read"), "n_all")
