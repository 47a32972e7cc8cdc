"""Dynamic labels: plausible names that were dropped often enough become labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T


def candidates(dropped: DataFrame) -> DataFrame:
    """(domain, label, occurrences, first_seen, last_seen) from dropped names (domain, name, doc_id, seen)."""
    name = T.strip(F.col("name"))
    # Each different name is looked at once.
    one = dropped.groupBy("domain", "name").agg(F.count("*").alias("n"), F.min("seen").alias("first"), F.max("seen").alias("last"))
    return (
        one.where(T.plausible_entity(F.col("name")))
        .groupBy("domain", F.lower(name).alias("key"))
        .agg(
            F.min_by(name, F.struct("first", name)).alias("label"), F.sum("n").alias("occurrences"),
            F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        )
    )


def evict(found: DataFrame, now: int, ttl_docs: int) -> DataFrame:
    """TTL: candidates not seen in the last ``ttl_docs`` documents go; now is the number of documents so far."""
    return found.where(F.lit(now) - F.col("last_seen") <= ttl_docs)


def state(found: DataFrame, promoted: DataFrame) -> DataFrame:
    """A row for each candidate (domain, key, label, occurrences, first_seen, last_seen, active), as a sink keeps
    it by domain and key."""
    active = promoted.select("domain", "key").distinct().withColumn("active", F.lit(True))
    full = found.join(active, ["domain", "key"], "left").withColumn("active", F.coalesce("active", F.lit(False)))
    return full.select("domain", "key", "label", "occurrences", "first_seen", "last_seen", "active")


def promote(found: DataFrame, least: int = C.PROMOTE_AT, cap: int = C.LABEL_CAP) -> DataFrame:
    """Those seen often enough; beyond the cap the least recently seen go."""
    from quillspark.operators.ranking import top_per

    order = [F.col("last_seen").desc(), F.col("occurrences").desc(), F.col("key")]
    return top_per(found.where(F.col("occurrences") >= least), ["domain"], order, cap)


def origins(typed: DataFrame) -> DataFrame:
    """Provenance: each inferred type with the names that led to it."""
    return typed.groupBy("domain", "type").agg(F.array_sort(F.collect_set("name")).alias("names"))
