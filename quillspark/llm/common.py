"""What the training-data operators share: staged tables, batches of text, connected components, running sums.

Lineage is cut by tables written under ``spark.checkpoint.dir`` and read back (``quillspark.staging``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark import staging
from quillspark.shipping import ship
from quillspark.staging import unstage

#: Characters of text that one step of a Python operator holds as Python objects.
SLICE_CHARS = 1_000_000

#: Bytes that a rolling hash is taken of at once.
PIECE = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors and bounds the session's Arrow batches."""
    ship(spark)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``staging.stage`` in a session that is prepared for Python workers."""
    prepare(df.sparkSession)
    return staging.stage(df, tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever columns it brings."""
    have = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in have:
        n += 1
        name = f"{stem}_{n}"
    return name


def guard(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but those used under a name no operator uses, and what gives the names back.

    So extra columns may have any name, also one that an operator makes for itself.
    """
    names = docs.columns
    new = [c if c in used else f"_extra{i}" for i, c in enumerate(names)]

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(n) for n in new]).toDF(*names)

    return docs.toDF(*new), back


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows of at most ``most`` bytes of text (one row at least), with the texts as UTF-8, None for null."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
        at = to


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    out = np.full(n, _INVERSE if inverse else _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """0 to n - 1 as powers of the odd base of rolling hashes (or of its inverse), modulo 2 ** 64."""
    if n > PIECE:
        return _powers.__wrapped__(n, inverse)
    return _powers(PIECE, inverse)[:n]


_BYTE = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(_BASE))


def hashed_words(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, last byte, 64-bit hash) of each run of bytes that aren't space; the data end with one.

    Hashes are made for ``PIECE`` bytes at once (a longer word is one piece), so their memory doesn't grow with a text.
    """
    was = np.append(True, space[:-1])
    start, end = np.flatnonzero(~space & was), np.flatnonzero(space & ~was) - 1
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE)))
        a, b, at = start[i], end[j - 1] + 1, start[i:j] - start[i]
        value = np.where(space[a:b], np.uint64(0), _BYTE[data[a:b]]) * powers(b - a)
        out[i:j] = mix(np.add.reduceat(value, at) * powers(b - a, True)[at])
        i = j
    return start, end, out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each node of ``edges(a, b)`` reaches.

    Alternating large-star and small-star rounds: each is two joins on a node, so that rows of a node with
    very many edges are split by adaptive execution, and minima are combined before they are shuffled.
    """
    spark = edges.sparkSession
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )

    def sign(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    before = sign(now)
    if not before[0]:
        return spark.createDataFrame([], "node long, component long")
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "cc")
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        after = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "cc")
        unstage(large)
        unstage(now)
        now, mark = after, sign(after)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows of its group that come before, in ``order``.

    No window: a group with a third of all rows would be one task. Rows are range-sorted by group and order into a
    staged table; each of its partitions adds up its own rows, and gets the sums of the earlier ones from a table of
    one row for each partition and group that meet. ``value`` must be integer; sums are exact, so they don't depend
    on where the partitions end.
    """
    spark, block, own = df.sparkSession, free_name(df, "block"), free_name(df, "own")
    keys = [F.col(group).asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in order)]
    ranged = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(block, F.spark_partition_id()), "runs"
    )
    totals = ranged.groupBy(group, block).agg(F.sum(value).alias(own))
    # A group's blocks are consecutive: few rows a group, one for each block it reaches.
    before = totals.select(
        F.col(group).alias("_g"),
        F.col(block).alias("_b"),
        F.coalesce(
            F.sum(own).over(W.partitionBy(group).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).cast("long").alias("_before"),
    )
    joined = ranged.join(before, ranged[group].eqNullSafe(before["_g"]) & (ranged[block] == before["_b"]), "left")
    w = (
        W.partitionBy(block, group)
        .orderBy(*(F.col(c).asc_nulls_last() for c in order))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return joined.withColumn(
        out, (F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0))).cast("long")
    ).drop("_g", "_b", "_before", block)
