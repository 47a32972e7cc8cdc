"""Retrieval and answer metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.functions.vectors import cosine, hash_embed, once


def union_terms(contexts: Column, terms=T.content_terms) -> Column:
    return F.array_distinct(F.flatten(F.transform(contexts, lambda c: terms(c))))


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Sentences of which half the content terms are in the contexts, over all sentences; abstentions count 1."""
    a = T.strip(F.coalesce(answer, F.lit("")))
    abstains = reduce(lambda x, y: x | y, (F.contains(F.lower(a), F.lit(p)) for p in C.ABSTENTIONS))
    sents = T.eval_sentences(a)

    def supported(t: Column, known: Column) -> Column:
        return F.coalesce(F.when(F.size(t) > 0, F.size(F.array_intersect(t, known)) / F.size(t)) >= C.SUPPORT, F.lit(False))

    def held_up(all_: Column, known: Column) -> Column:
        return F.size(F.filter(all_, lambda s: once(T.content_terms(s), lambda t: supported(t, known)))) / F.size(all_)

    share = once(sents, lambda all_: once(union_terms(contexts), lambda known: held_up(all_, known)))
    return F.when(a == "", 0.0).when(abstains, 1.0).when(F.size(sents) == 0, 0.0).otherwise(share)


def recall(truth: Column, contexts: Column, embed=hash_embed) -> Column:
    """The truth's terms that the contexts have; by cosine with the first three contexts for very short truths."""
    t = F.array_distinct(T.long_tokens(truth))
    c = F.array_distinct(F.flatten(F.transform(contexts, T.long_tokens)))
    near = F.greatest(F.lit(0.0), cosine(embed(truth), embed(F.array_join(F.slice(contexts, 1, 3), " "))))
    none = (F.coalesce(truth, F.lit("")) == "") | (F.coalesce(F.size(contexts), F.lit(0)) <= 0)
    share = F.size(F.array_intersect(t, c)) / F.size(t)
    return F.when(none, 0.0).when(F.size(t) <= C.SHORT_TRUTH, near).otherwise(share)


def relevancy(question: Column, answer: Column, embed=hash_embed) -> Column:
    """E2."""
    return F.greatest(F.lit(0.0), cosine(embed(question), embed(answer)))


def decomposed_relevancy(question: Column, answer: Column) -> Column:
    """Names the document (or shares a long term), speaks of a purpose, has a number; a third each."""
    q, a = F.lower(question), F.lower(answer)
    name = T.strip(F.regexp_extract(q, C.TEMPLATE_QUESTION, 1))
    long = lambda x: F.regexp_extract_all(x, F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{4,}"), F.lit(0))
    named = F.when(name != "", F.contains(a, name)).otherwise(F.arrays_overlap(long(q), long(a)))
    purpose = reduce(lambda x, y: x | y, (F.contains(a, F.lit(p)) for p in C.PURPOSES))
    number = answer.rlike(r"(?<![\p{L}\p{N}_])\d+(?![\p{L}\p{N}_])")
    n = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (named, purpose, number)), F.lit(0))
    empty = (F.coalesce(question, F.lit("")) == "") | (F.coalesce(answer, F.lit("")) == "")
    return F.when(empty, 0.0).otherwise(n / 3)


def precision(reference: Column, contexts: Column, embed=hash_embed) -> Column:
    """Contexts whose cosine with the reference reaches the bar."""
    hit = once(embed(reference), lambda ref: F.filter(contexts, lambda c: F.round(cosine(ref, embed(c)), 9) >= C.RELEVANT_COSINE))
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) <= 0, 0.0).otherwise(F.size(hit) / F.size(contexts))


def sentence_precision(reference: Column, contexts: Column, embed=hash_embed) -> Column:
    """E5: contexts with any such sentence."""

    def near(ref: Column, c: Column) -> Column:
        return F.exists(T.eval_sentences(c), lambda s: F.round(cosine(ref, embed(s)), 9) >= C.RELEVANT_COSINE)

    hit = once(embed(reference), lambda ref: F.filter(contexts, lambda c: near(ref, c)))
    return F.when(F.coalesce(F.size(contexts), F.lit(0)) <= 0, 0.0).otherwise(F.size(hit) / F.size(contexts))


def jaccard(truth: Column, contexts: Column) -> Column:
    """Of distinct tokens; null for a truth without any."""
    t = F.array_distinct(T.tokens(truth))
    c = F.array_distinct(F.flatten(F.transform(contexts, T.tokens)))
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, c)) / F.greatest(F.size(F.array_union(t, c)), F.lit(1)))


def retrievability(score: Column) -> Column:
    return F.when(score < C.LOW_JACCARD, "LOW").when(score < C.MARGINAL_JACCARD, "MARGINAL").otherwise("OK")


def report(rows: DataFrame, *metrics: str) -> DataFrame:
    """Means to four places, and the number of rows."""
    return rows.agg(*[F.bround(F.avg(m), 4).alias(m) for m in metrics], F.count("*").alias("n_samples"))


def four_metrics(rows: DataFrame, embed=hash_embed) -> DataFrame:
    """Rows (question, ground_truth, answer, contexts) with E1, E3, E5 and E6 of each."""
    q, truth, a, c = (F.col(x) for x in ("question", "ground_truth", "answer", "contexts"))
    reference = F.when(F.coalesce(truth, F.lit("")) == "", q).otherwise(truth)
    return rows.withColumns({
        "faithfulness": faithfulness(a, c), "answer_relevancy": decomposed_relevancy(q, a),
        "context_precision": sentence_precision(reference, c, embed), "context_recall": recall(truth, c, embed),
    })


FOUR = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def gates(measured: DataFrame) -> DataFrame:
    """(gate, value, bar, passed) for each gate that the one row of ``measured`` has a column of; a null value
    fails."""
    bars = {**{g: (b, True) for g, b in C.GATES_LEAST.items()}, **{g: (b, False) for g, b in C.GATES_MOST.items()}}
    rows = [
        F.struct(
            F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.lit(b).alias("bar"),
            F.coalesce(F.col(g) >= b if least else F.col(g) <= b, F.lit(False)).alias("passed"),
        )
        for g, (b, least) in bars.items() if g in measured.columns
    ]
    return measured.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def identity_recall(hits: DataFrame) -> DataFrame:
    """Of queries made from a document's own first words, the share whose hits hold that document.

    hits: (qid, id) with qid the document.
    """
    found = hits.groupBy("qid").agg(F.max((F.col("qid") == F.col("id")).cast("int")).alias("hit"))
    return found.agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.bround(F.avg("hit"), 4).alias("recall"))


def provenance(contexts: DataFrame) -> DataFrame:
    """The share of contexts that name both their document and their domain."""
    ok = (F.coalesce("doc_id", F.lit("")) != "") & (F.coalesce("domain", F.lit("")) != "")
    return contexts.agg(F.count("*").alias("n"), F.bround(F.avg(ok.cast("int")), 4).alias("coverage"))
