
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.staging import stage


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """A row number over all rows from 1: range-sorted partitions count their own rows, and get the number of rows in
    the partitions before from a table of one row a partition."""
    keys = [F.col(c) for c in order]
    # Staged: the same split for both uses. The rank doesn't depend on where it falls.
    ranged = stage(df.repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_block",
        F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    own = F.row_number().over(W.partitionBy("_block").orderBy(*keys))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_block").withColumn(
        out, F.col("_own") + F.col("_before")
    ).drop("_block", "_own", "_before")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts each partition's groups to k before it shuffles them."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_per(df, keys, order, 1, "_first").drop("_first")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, for rows of which few are alike: they are dealt by all their columns and then sorted.

    ``distinct`` would combine them before, holding all that a task reads, and hold them in a hash map again after. A sort
    holds what a shuffle deals to a task (which Spark bounds), once, and can spill.
    """
    return first_per(df.repartition(*df.columns), df.columns, [F.col(df.columns[0])])


def stable_order(df: DataFrame, boost: Column, arrival: str, k: int, keys: list[str]) -> DataFrame:
    """L4: falling boost, then order of arrival."""
    return top_per(df.withColumn("boosted", boost), keys, [F.col("boosted").desc(), F.col(arrival)], k)
