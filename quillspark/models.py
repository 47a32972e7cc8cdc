"""Models as plug-ins, with deterministic defaults that need no weights.

An embedder maps a Column of text to a Column of float arrays; a reranker two Columns to a score; a recogniser a
Column of text to an array of (text, label, start, end); a synthesiser a Column of prompts (or contexts) to text. The
defaults (hashed counts, token overlap, a gazetteer, extraction) make the plans testable. They say nothing about the
quality that trained models would give.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import content_terms, sentences, tokens
from quillspark.functions.vectors import hash_embed

Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]
Recogniser = Callable[[Column], Column]
Synthesiser = Callable[[Column, Column], Column]
SPANS = "array<struct<text: string, label: string, start: int, end: int>>"


def overlap_score(query: Column, text: Column) -> Column:
    """X10's default: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def gazetteer(names: dict[str, str]) -> Recogniser:
    """X1's default: whole-word, case-blind matches of known names (at most what fits a closure), first per name and label."""
    pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", re.I)
    label = {k.lower(): v for k, v in names.items()}

    @F.pandas_udf(SPANS)
    def find(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            out: dict[tuple, dict] = {}
            for m in pattern.finditer(t or "") if names else ():
                kind = label[m[1].lower()]
                out.setdefault((m[1].lower(), kind), {"text": m[1], "label": kind, "start": m.start(), "end": m.end()})
            return list(out.values())

        return text.map(one)

    return find


def id_recogniser(text: Column) -> Column:
    """Another recogniser, in the JVM: ids such as ABC-12 (no offsets)."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]{2,}-\d+\b"), F.lit(0)))
    return F.transform(found, lambda t: F.struct(t.alias("text"), F.lit("Id").alias("label")))


def extractive_answer(query: Column, contexts: Column) -> Column:
    """X11's default: the context sentence with most of the query's terms; '' without contexts."""
    terms = content_terms(query)
    sents = F.flatten(F.transform(contexts, sentences))
    scored = F.transform(
        sents, lambda s, i: F.struct(F.size(F.array_intersect(terms, tokens(s))).alias("n"), (-i).alias("i"), s.alias("s"))
    )
    return F.coalesce(F.array_max(scored)["s"], F.lit(""))


def lead_summary(text: Column, most: int = 3) -> Column:
    """X7's default: the first sentences."""
    return F.array_join(F.slice(sentences(text), 1, most), " ")


_built: dict[str, Callable] = {}


def by_batches(name: str, build: Callable[[], Callable[[list[str]], list]], returns: str, size: int = 64) -> Callable[[Column], Column]:
    """X8-X10 for models with weights: a function of a Column of text, run in Arrow batches.

    ``build`` loads the model and is called once in each Python worker, under ``name``, however many tasks and queries the
    worker serves; the model gets lists of at most ``size`` texts (null as '') and returns as many values.
    """

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from quillspark import models  # the worker's own module, not what travels with this function

        model = models._built.get(name)
        if model is None:
            model = models._built[name] = build()
        for texts in batches:
            whole = texts.fillna("").tolist()
            yield pd.Series([x for i in range(0, len(whole), size) for x in model(whole[i : i + size])])

    return run


@dataclass(frozen=True)
class Models:
    embed: Embedder = hash_embed
    rerank: Reranker = overlap_score
    recognise: Recogniser = id_recogniser
    synthesise: Synthesiser = extractive_answer
    summarise: Callable[[Column], Column] = lead_summary
    extra: dict[str, object] = field(default_factory=dict)
