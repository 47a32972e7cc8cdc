"""Sinks: tables kept by key with overwrite of what changes, and logs.

Parquet has no MERGE: an upsert is the rows of other keys united with the new ones. A table is a folder of versions and
one small file that names the current one; a new version is written beside the old ones and then named by renaming that
file over the old one, in one step. So a reader sees the old table or the new one, and after a crash the old one. Tables
are read with ``read``; versions before the last but one are deleted.

A change is a compare-and-set: it names the version that it was made from, and of two writers that began with one version
the second gets ``Conflict`` and can begin again. The file also keeps the columns that the table is partitioned by, so a
delete keeps the layout. Every version is written whole; ``sources.keyed`` has tables that rewrite what a batch touches.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.graph import delete_document

POINTER, LOCK = "_CURRENT", "_LOCK"


class Conflict(RuntimeError):
    """Someone else has changed the table, or is about to."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, path: str) -> list[str]:
    fs, pointer = _fs(spark, path), _path(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return []
    stream = fs.open(pointer)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()


def _current(spark: SparkSession, path: str) -> list[str]:
    """Names of the current version and the one before it; none where there is no table."""
    return [x for x in _pointer(spark, path) if x and not x.startswith("by ")]


def layout(spark: SparkSession, path: str) -> list[str]:
    """The columns that the table is partitioned by."""
    return next((x[3:].split("\t") for x in _pointer(spark, path) if x.startswith("by ")), [])


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds the table's lock, a file that only one can create; Conflict where it is there. A crash leaves it: delete it
    when its owner (in the file) is gone."""
    fs, lock = _fs(spark, path), _path(spark, f"{path}/{LOCK}")
    try:
        out = fs.create(lock, False)
    except Py4JJavaError as e:
        if fs.exists(lock):
            raise Conflict(f"{path} is locked by {LOCK}") from e
        raise
    try:
        out.write(bytearray(spark.sparkContext.applicationId.encode()))
        out.close()
        yield
    finally:
        fs.delete(lock, False)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_current(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    found = _current(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/{found[0]}")


def replace(df: DataFrame, path: str, by: list[str] = (), made_from: str | None = "any") -> None:
    """The table becomes df, in one step. made_from: the version that df was made from (None: no table); Conflict
    where it is no longer the current one. "any": whatever is there goes."""
    spark = df.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{path}/{name}")
    jvm, fs = spark.sparkContext._jvm, _fs(spark, path)
    with locked(spark, path):
        before = _current(spark, path)[:1]
        if made_from != "any" and before != ([made_from] if made_from else []):
            fs.delete(_path(spark, f"{path}/{name}"), True)
            raise Conflict(f"{path} is no longer {made_from}")
        new = f"{path}/_{name}.pointer"
        out = fs.create(_path(spark, new))
        out.write(bytearray("\n".join([name, *before, *(["by " + "\t".join(by)] if by else [])]).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        qualified = [_path(spark, p).makeQualified(fs.getUri(), fs.getWorkingDirectory()) for p in (new, f"{path}/{POINTER}")]
        files.rename(*qualified, overwrite)
        for status in fs.listStatus(_path(spark, path)):
            old = status.getPath().getName()
            if old.startswith("v-") and old not in (name, *before):
                fs.delete(status.getPath(), True)


def one_per_key(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key, nulls being a key too: the last by ``order``, and by a hash of the row where that is equal."""
    w = W.partitionBy(*keys).orderBy(*([F.col(order).desc_nulls_last()] if order else []), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def others(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of old whose key, null or not, new doesn't have."""
    sent = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = [old[k].eqNullSafe(sent[f"_k{i}"]) for i, k in enumerate(keys)]
    return old.join(sent, same, "left_anti")


def upsert(df: DataFrame, path: str, keys: list[str], by: list[str] = (), order: str | None = None) -> None:
    """K1: rows of df take the place of those with their keys (K2: the table is made where it is missing). Of several rows
    of a key in df one counts (``one_per_key``). by: partitions, of a table that is there its own unless given."""
    spark = df.sparkSession
    df = one_per_key(df, keys, order)
    found = _current(spark, path)[:1]
    if found:
        old = spark.read.parquet(f"{path}/{found[0]}")
        df = others(old, df, keys).unionByName(df, allowMissingColumns=True)
    replace(df, path, by or layout(spark, path), found[0] if found else None)


def delete(spark: SparkSession, path: str, condition) -> int:
    """K6: rows that meet the condition go; returns how many. The table stays partitioned as it is."""
    found = _current(spark, path)
    if not found:
        raise FileNotFoundError(path)
    table = spark.read.parquet(f"{path}/{found[0]}")
    n = table.where(condition).count()
    if n:
        replace(table.where(~F.coalesce(condition, F.lit(False))), path, layout(spark, path), found[0])
    return n


def delete_ingest(spark: SparkSession, doc_id, chunks: str, nodes: str, edges: str) -> dict[str, int]:
    """K7: a document goes from the tables of chunks (doc_id), nodes and edges (source_docs). Returns the numbers of
    chunks deleted and of nodes that named it; KeyError where none of either does."""
    doc = F.lit(doc_id)
    n_chunks = read(spark, chunks).where(F.col("doc_id") == doc).count() if exists(spark, chunks) else 0
    graph = exists(spark, nodes) and exists(spark, edges)
    n_nodes = read(spark, nodes).where(F.array_contains("source_docs", doc)).count() if graph else 0
    if not n_chunks and not n_nodes:
        raise KeyError(doc_id)
    if n_chunks:
        delete(spark, chunks, F.col("doc_id") == doc)
    if graph:
        versions = [_current(spark, x)[0] for x in (nodes, edges)]
        left, kept = delete_document(read(spark, nodes), read(spark, edges), doc)
        replace(left, nodes, layout(spark, nodes), versions[0])
        replace(kept, edges, layout(spark, edges), versions[1])
    return {"vectors": n_chunks, "nodes": n_nodes}


def store_answers(answers: DataFrame, path: str) -> None:
    """K9: cacheable answers only (not degraded; not empty where one was asked for), one for each query and scope."""
    ok = answers.where("not degraded and (not synthesize or coalesce(answer, '') <> '')")
    upsert(ok.dropDuplicates(["query", "scope"]), path, ["query", "scope"])


def append_log(rows: DataFrame, path: str) -> None:
    """K12."""
    rows.write.mode("append").json(path)


def reembed(chunks: DataFrame, embed, text: str = "text", vector: str = "vector") -> DataFrame:
    """The dense vector anew from the text; all other columns, the sparse vector too, stay."""
    return chunks.withColumn(vector, embed(F.col(text)))


def differential_id(query: str, mode: str = "differential", min_confidence: str | None = None) -> str:
    return hashlib.sha256("|".join([query, mode, min_confidence or ""]).encode()).hexdigest()


def delete_differential(spark: SparkSession, path: str, query: str, mode: str = "differential", min_confidence: str | None = None) -> int:
    """A stored differential goes with its candidates; returns 1, or 0 where there is none."""
    return int(exists(spark, path) and delete(spark, path, F.col("id") == differential_id(query, mode, min_confidence)) > 0)


def persist_differential(ranked: DataFrame, header: dict[str, str], path: str) -> None:
    """K8: candidates (rank, candidate, confidence, dual, score) under a stable id of query, mode and floor."""
    key = F.lit(differential_id(**{k: header[k] for k in ("query", "mode", "min_confidence")}))
    rows = ranked.select(key.alias("id"), *[F.lit(header[k]).alias(k) for k in ("query", "mode", "min_confidence")], *ranked.columns)
    stored = rows.withColumn("created", F.current_timestamp())
    spark = ranked.sparkSession
    if exists(spark, path):
        old = read(spark, path).join(stored.select("id").distinct(), "id", "left_anti")
        stored = old.unionByName(stored)
    replace(stored, path)


def list_differentials(spark: SparkSession, path: str, n: int, query: str | None = None) -> DataFrame:
    """Newest first, or those of exactly this query; candidates in rank order."""
    rows = read(spark, path)
    if query is not None:
        rows = rows.where(F.col("query") == query)
    listed = rows.groupBy("id", "query", "mode", "min_confidence").agg(
        F.max("created").alias("created"), F.array_sort(F.collect_list(F.struct("rank", "candidate", "confidence"))).alias("candidates")
    )
    return listed.orderBy(F.col("created").desc(), "id").limit(n)
