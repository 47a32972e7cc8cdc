"""Alias maps and query expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.staging import stage


def alias_map(entities: DataFrame) -> DataFrame:
    """(alias, canonical) from entities (name, type, aliases, ord): an explicit alias beats a name, the last of
    several wins."""
    e = entities.where("name is not null and trim(name) <> ''").withColumn("name", T.strip(F.col("name")))
    named = e.select(F.explode("aliases").alias("alias"), "name", F.lit(1).alias("p"), "ord").union(
        e.where("coalesce(type, '') <> ''").select("name", "name", F.lit(0).alias("p"), -F.col("ord"))
    )
    keyed = named.select(F.lower(T.strip(F.col("alias"))).alias("alias"), "name", "p", "ord").where("alias <> ''")
    return keyed.groupBy("alias").agg(F.max_by("name", F.struct("p", "ord", "name")).alias("canonical"))


def expand_queries(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, text, expanded): canonical names of aliases that the query has as whole words, longest first.

    Queries meet aliases by an equality join on the alias's first word; only ids and words are joined, and each text meets
    its own candidates once, where the whole alias is tested. The aliases are staged, so that Spark knows their size.
    """
    a = aliases.where(F.lower("canonical") != F.col("alias"))
    first = F.regexp_extract("alias", r"[\p{L}\p{N}_]+", 0)
    a = stage(a.select("alias", "canonical", first.alias("word")).where("word <> ''"), "aliases")
    said = queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    # Of aliases with one canonical name the longest counts; the order is by that length, then the alias.
    one = F.struct((-F.length("alias")).alias("n"), "alias", "canonical", (F.col("alias") == F.col("word")).alias("met"))
    met = said.join(a, "word").groupBy("qid").agg(F.array_sort(F.collect_set(one)).alias("xs"))
    low = F.lower("text")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    edge = r"[\p{L}\p{N}_]"
    pattern = lambda alias: F.concat(F.lit(f"(?<!{edge})\\Q"), alias, F.lit(f"\\E(?!{edge})"))
    # An alias of one word is met by the join itself.
    whole = F.filter("xs", lambda x: x["met"] | (F.contains(low, x["alias"]) & F.regexp_like(pad(low), pattern(x["alias"]))))
    full = queries.join(met, "qid", "left").withColumn("xs", whole)
    # Where the first of each canonical name stands, and what is there.
    names = F.transform("xs", lambda x: F.lower(x["canonical"]))
    firsts = F.filter("xs", lambda x, i: F.array_position(F.col("_names"), F.lower(x["canonical"])) == i + 1)
    full = full.withColumn("_names", names).withColumn("xs", firsts)
    added = F.array_join(F.transform("xs", lambda x: x["canonical"]), "; ")
    return full.select(
        "qid", "text",
        F.when(F.coalesce(F.size("xs"), F.lit(0)) <= 0, F.col("text")).otherwise(F.concat("text", F.lit(" ("), added, F.lit(")"))).alias("expanded"),
    )
