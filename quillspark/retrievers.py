"""The retriever registry and federated retrieval.

A retriever is a function of a queries table (qid, text[, vector]) and k; it returns records (qid, arrival, text,
doc_id, doc_type[, concept_id]). All signals of all queries are one plan.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.config import Profile, Profiles
from quillspark.operators import fusion
from quillspark.operators import graph as G
from quillspark.operators.aliases import expand_queries
from quillspark.operators.ranking import top_per
from quillspark.operators.search import top_k
from quillspark.staging import stage

Retriever = Callable[[DataFrame, int], DataFrame]

#: What no source is to blame for: fewer records must not pass for an answer then.
ENGINE_FAILURE = re.compile(r"ExecutorLostFailure|FetchFailed|No space left on device|OutOfMemoryError|SparkContext was shut down|cancelled")


class Registry:
    """An override, else the domain's own retriever, else the default; temporal ones for JSON presentations."""

    def __init__(self, profiles: Profiles, default: Callable[[Profile], Retriever]) -> None:
        self.profiles, self._default = profiles, default
        self._own: dict[str, Retriever] = {}
        self._temporal: dict[str, Retriever] = {}

    def register(self, domain: str, retrieve: Retriever, temporal: Retriever | None = None) -> None:
        self._own[domain] = retrieve
        if temporal:
            self._temporal[domain] = temporal

    def get(self, domain: str, temporal: bool = False) -> Retriever:
        p = self.profiles.get(domain)
        if temporal and p.name in self._temporal:
            return self._temporal[p.name]
        return self._own.get(p.name) or self._default(p)


def dense(chunks: DataFrame, embed, prefix: str = "") -> Retriever:
    """Nearest chunks (id, text, doc_id, doc_type, vector[, title, concept_id]); a title goes between prefix and
    text, on a line of its own."""
    chunks = chunks.withColumn("text", F.concat(F.lit(prefix), F.concat_ws("\n", "title", "text") if "title" in chunks.columns else F.col("text")))

    def retrieve(queries: DataFrame, k: int) -> DataFrame:
        q = queries if "vector" in queries.columns else queries.withColumn("vector", embed(F.col("text")))
        hits = top_k(q.select("qid", "vector"), chunks.select("id", "vector"), k)
        return hits.join(chunks.drop("vector"), "id").withColumnRenamed("rank", "arrival").drop("id")

    return retrieve


def graph_facts(nodes: DataFrame, edges: DataFrame, embed, strategy: str = "keyword", hops: int = 2, most: int = C.GRAPH_ROWS) -> Retriever:
    """Statements of the edges around each query's entry, by src, rel and dst; the first ``most`` of them."""

    def retrieve(queries: DataFrame, k: int) -> DataFrame:
        _, inside = G.subgraph(queries.select("qid", "text"), nodes, edges, hops, strategy=strategy, embed=embed)
        first = top_per(inside, ["qid"], [F.col("src"), F.col("rel"), F.col("dst")], most, "arrival")
        told = G.edge_statements(first.select("src", "dst", "rel").distinct(), nodes.select("id", "name"))
        return first.join(told, ["src", "dst", "rel"]).select("qid", "arrival", "text", "doc_type", F.lit("").alias("doc_id"))

    return retrieve


def default(name: str, chunks: DataFrame | None, nodes: DataFrame | None, edges: DataFrame | None, embed, strategy: str = "keyword") -> Retriever:
    """A domain's nearest chunks, tagged with its name, then its graph's first facts, tagged ``name:graph``. Either
    may be missing."""

    def retrieve(queries: DataFrame, k: int) -> DataFrame:
        parts = []
        if chunks is not None:
            parts.append(dense(chunks, embed)(queries, k).withColumn("signal", F.lit(name)))
        if nodes is not None and edges is not None:
            parts.append(graph_facts(nodes, edges, embed, strategy)(queries, k).withColumn("signal", F.lit(f"{name}:graph")))
        return fusion.union_signals(*parts)

    return retrieve


def with_aliases(retrieve: Retriever, aliases: DataFrame) -> Retriever:
    """The retriever with aliases (alias, canonical) applied to its queries first, so that what is embedded and matched
    has the canonical names too. Vectors that queries bring are of the text as it was, and are left out."""

    def expanded(queries: DataFrame, k: int) -> DataFrame:
        text = expand_queries(queries.select("qid", "text"), aliases).select("qid", F.col("expanded").alias("text"))
        return retrieve(text, k)

    return expanded


def federated(registry: Registry, domain: str, queries: DataFrame) -> tuple[DataFrame, list[str]]:
    """(records, failed): the domain's records and its companions', tagged by signal (a source's name, where its
    retriever has not tagged them). Each source is run and staged by itself: one that fails gives no records and is
    named in ``failed``, and the others still answer."""
    p = registry.profiles.get(domain)
    parts, failed = [], []
    for name in dict.fromkeys([p.name, *p.companions]):
        try:
            found = registry.get(name)(queries, registry.profiles.get(name).top_k)
            if "signal" not in found.columns:
                found = found.withColumn("signal", F.lit(name))
            parts.append(stage(found.withColumn("domain", F.lit(p.name)), "records"))
        except Exception as e:  # noqa: BLE001 - whatever the source's own code raises, the others answer
            if ENGINE_FAILURE.search(str(e)):
                raise
            logging.getLogger(__name__).warning("source %s failed: %s", name, type(e).__name__)
            failed.append(name)
    if not parts:
        kind = queries.schema["qid"].dataType.simpleString()
        none = f"qid {kind}, arrival int, text string, doc_id string, doc_type string, signal string, domain string"
        parts = [queries.sparkSession.createDataFrame([], none)]
    return fusion.union_signals(*parts), failed


def across(registry: Registry, queries: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Every domain's records."""
    return fusion.union_signals(*[federated(registry, d, queries)[0] for d in domains or registry.profiles.names()])


def ask(registry: Registry, domain: str, queries: DataFrame, k: int, models, least: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranked records, answers) of a batch of queries. Answers have ``failed``, the sources that gave none, and
    ``degraded`` where there are any, so that they are not cached (K9)."""
    found, failed = federated(registry, domain, queries)
    pool = fusion.dual_flags(fusion.dedupe(found))
    scored = pool.join(queries.select("qid", F.col("text").alias("_query")), "qid")
    rows = fusion.ranked(scored, k, models.rerank(F.col("_query"), F.col("text"))).drop("_query")
    if least:
        rows = fusion.floor(rows, least)
    answers = fusion.answer(rows, queries, models.synthesise)
    return rows, answers.withColumns({"failed": F.lit(failed).cast("array<string>"), "degraded": F.lit(bool(failed))})
