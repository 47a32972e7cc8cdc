"""Staged tables: a plan's result written once to the folder that driver and executors share, and read back.

Unlike ``DataFrame.checkpoint`` that computes the plan once, and a lost executor costs nothing but a reread.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []
#: The lists of ``noted`` around what runs; each thread has its own.
_noting: ContextVar[tuple[list, ...]] = ContextVar("noting", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it names none, a local session gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back; it is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _staged.append((spark, path))
    for tables in _noting.get():
        tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    path = getattr(df, "_quill_path", None)
    if path:
        _delete(df.sparkSession, path)
        _staged[:] = [x for x in _staged if x[1] != path]


@contextmanager
def noted(into: list[tuple[SparkSession, str]]) -> Iterator[None]:
    """Adds the tables that this thread stages inside to ``into``, for ``forget`` when they are no longer read."""
    mark = _noting.set((*_noting.get(), into))
    try:
        yield
    finally:
        _noting.reset(mark)


def forget(tables: list[tuple[SparkSession, str]]) -> None:
    """Deletes these tables and empties the list."""
    for x in tables:
        if x in _staged:
            _delete(*x)
            _staged.remove(x)
    tables.clear()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone already
            return
