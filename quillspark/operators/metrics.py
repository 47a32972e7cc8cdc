"""Latency and drift metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.operators.ranking import global_rank


def histogram(rows: DataFrame, value: str, buckets: list[float] = C.LATENCY_BUCKETS) -> DataFrame:
    """(le, n, cumulative): counts of the first bucket that holds a value. The table has one row a bucket."""
    spark = rows.sparkSession
    label = lambda b: "+Inf" if b == float("inf") else str(b)
    of = F.lit(len(buckets))
    for i, b in reversed(list(enumerate(buckets))):
        of = F.when(F.col(value) <= b, i).otherwise(of)
    n = rows.where(F.col(value).isNotNull()).groupBy(of.alias("i")).agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(i, label(b)) for i, b in enumerate(buckets)], "i int, le string")
    full = all_.join(n, "i", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("cumulative", F.sum("n").over(W.orderBy("i"))).select("le", "n", "cumulative")


def linear(value: str, *percents: float) -> list[Column]:
    """Interpolated at (n - 1) p / 100."""
    return [F.round(F.percentile(value, F.lit(p / 100)), 6).alias(f"p{p:g}") for p in percents]


def exclusive(rows: DataFrame, group: str, value: str, cut: int = 19, of: int = 20) -> DataFrame:
    """The cut-th of ``of`` exclusive quantiles: interpolated at (n + 1) cut / of, within the group."""
    x = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    # Ranks over all rows by group and value, less those of the groups before: no task sorts a group of its own.
    x = global_rank(x, [group, "v"], "i")
    sizes = x.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"), F.min("i").alias("first"))
    x = x.join(sizes, x[group].eqNullSafe(sizes["_g"])).withColumn("i", F.col("i") - F.col("first") + 1)
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor((F.col("n") + 1) * cut / of)))
    share = (F.col("n") + 1) * cut / of - at
    near = x.where((F.col("i") == at) | (F.col("i") == at + 1))
    return near.groupBy(group).agg(
        F.round(F.sum(F.when(F.col("i") == at, F.col("v") * (1 - share)).otherwise(F.col("v") * share)), 6).alias("quantile")
    )


def sketch_error(k: int) -> float:
    """How far the rank of a sketch's quantile is from the asked one, as a share of n: twice the bound that KLL sketches of
    this size, merged or not, keep with a confidence of 99 %."""
    return 2 * 2.296 / k**0.9723


def sketches(rows: DataFrame, keys: list[str | Column], value: str, k: int = C.SKETCH_SIZE) -> DataFrame:
    """A15 that can be kept and merged: (keys, n, sketch), a KLL sketch for each group; nulls don't count. Its size is
    bounded by k, whatever the group has."""
    some = rows.where(F.col(value).isNotNull()).groupBy(*keys)
    return some.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged_sketches(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones (hours to days, sources to all), no value read again."""
    return kept.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(kept: DataFrame, *shares: float) -> DataFrame:
    """(keys, n, p, q): a row for each group and share p, with the sketch's quantile q."""
    each = F.array(*[F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("q")) for p in shares])
    return kept.select(*[c for c in kept.columns if c != "sketch"], F.inline(each))


def stages(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """A18."""
    return rows.groupBy(stage).agg(
        F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n")
    )


def drift(rows: DataFrame, key: str, dropped: Column, entities: Column) -> DataFrame:
    """Dropped names in percent of entities, and the verdict."""
    total = rows.groupBy(key).agg(F.sum(dropped).alias("dropped"), F.sum(entities).alias("entities"))
    pct = F.when(F.col("entities") > 0, F.bround(F.col("dropped") * 100.0 / F.col("entities"), 4)).otherwise(0.0)
    verdict = F.when(F.col("pct") >= C.DRIFT_HIGH, "high").when(F.col("pct") <= C.DRIFT_LOW, "low").otherwise("medium")
    return total.withColumn("pct", pct).withColumn("verdict", verdict)
