"""Large tables by key: a batch rewrites the partitions that it touches, and no other.

Rows are partitioned by a hash of their key. An upsert or delete reads the partitions that its keys fall into, joins
there, and writes them back by dynamic partition overwrite; all other partitions keep their files. Which partitions these
are is a set of at most ``parts`` numbers. Writers hold the table's lock (``sinks.locked``).

Partitions are moved into place one after another: a reader in that moment, or after a crash, can see some changed and
some not. Batches are by key, so one that was cut off is sent again. ``sinks`` has tables that change in one step.

Defined cases: a null is a key; of several rows of a key in a batch one counts (``sinks.one_per_key``); columns that a
batch lacks are null, new ones are added. A delete of unknown keys changes nothing. A partition without rows is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.sinks import _fs, _path, locked, one_per_key, others
from quillspark.staging import stage, unstage

PARTS, PART = 64, "_part"


def _part(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(parts)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    fs = _fs(spark, path)
    return fs.exists(_path(spark, path)) and any(s.getPath().getName().startswith(f"{PART}=") for s in fs.listStatus(_path(spark, path)))


def read(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.option("mergeSchema", "true").parquet(path).drop(PART)


def _rewrite(spark: SparkSession, path: str, rows: DataFrame, touched: list[int]) -> None:
    """rows, with their partition, are all that is left of the touched partitions."""
    staged = stage(rows, "keyed")
    left = {r[PART] for r in staged.select(PART).distinct().collect()}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    for k in set(touched) - left:
        _fs(spark, path).delete(_path(spark, f"{path}/{PART}={k}"), True)
    unstage(staged)


def _old(spark: SparkSession, path: str, touched: list[int]) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).where(F.col(PART).isin(touched))


def upsert(df: DataFrame, path: str, keys: list[str], parts: int = PARTS, order: str | None = None) -> int:
    """K1: rows of df take the place of those with their keys. Returns the number of partitions rewritten."""
    spark = df.sparkSession
    new = stage(one_per_key(df, keys, order).withColumn(PART, _part(keys, parts)), "batch")
    touched = sorted(r[PART] for r in new.select(PART).distinct().collect())
    if touched:
        with locked(spark, path):
            rows = new
            if exists(spark, path):
                rows = others(_old(spark, path, touched), new, keys).unionByName(new, allowMissingColumns=True)
            _rewrite(spark, path, rows, touched)
    unstage(new)
    return len(touched)


def delete(gone: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> int:
    """K6: rows with the keys of ``gone`` go. Returns the number of partitions rewritten."""
    spark = gone.sparkSession
    if not exists(spark, path):
        return 0
    sent = stage(gone.select(*keys).distinct().withColumn(PART, _part(keys, parts)), "gone")
    touched = sorted(r[PART] for r in sent.select(PART).distinct().collect())
    if touched:
        with locked(spark, path):
            old = _old(spark, path, touched)
            touched = sorted(r[PART] for r in old.join(sent.select(*keys), [old[k].eqNullSafe(sent[k]) for k in keys], "left_semi").select(PART).distinct().collect())
            if touched:
                _rewrite(spark, path, others(_old(spark, path, touched), sent, keys), touched)
    unstage(sent)
    return len(touched)
