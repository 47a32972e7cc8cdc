"""A training-data pipeline over ``documents``: five stages, each one operator of ``quillspark.llm``.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; each stage's result is written as Parquet and
read again as the next one's docs. ``run`` deletes what a stage has staged for itself, and what the stage read, when its
result is written. What the last result reads stays until the application ends, so results of several runs, in any
order or thread, don't touch each other. The same holds of a stage that is called by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import stage, table
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.mixing import mixed
from quillspark.llm.simhash_dedup import simhash_dedup
from quillspark.llm.substring_dedup import substring_dedup
from quillspark.llm.toxicity import reject_toxic, train
from quillspark.staging import forget, noted, unstage

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger doesn't reject. It learns from the whole table's labels, like op7."""
    tagger = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return reject_toxic(docs, tagger)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row, with its text, for each time that words of a document are taken, in the order of finish times."""
    return mixed(docs)


STAGES: list[tuple[str, Step]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The trained tagger and XXH64 have no DuckDB form. tests/llm holds near_dedup, substrings, decontamination and mixing
#: against brute force, and the tagger's marginals and scores against enumeration.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, run_step in STAGES[:-1]:
        own: list = []
        with noted(own):
            out = run_step(spark, docs, sf_dir)
        read, docs = docs, stage(out, name)
        forget(own)
        unstage(read)
    return STAGES[-1][1](spark, docs, sf_dir)
