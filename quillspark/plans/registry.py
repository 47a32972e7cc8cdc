"""Registered queries: a function of (spark, sf_dir), and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tok(text: str) -> str:
    """SQL of T11."""
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sents(text: str) -> str:
    """SQL of T2: RE2 has no look-behind, so breaks become chr(1)."""
    cut = rf"string_split(replace(regexp_replace({text}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: trim(x, {BLANKS})), lambda x: x <> '')"


def words(text: str) -> str:
    return rf"regexp_extract_all({text}, '\S+')"


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
