"""Graph extraction: recognised entities, co-occurrence, parsed and validated relations (X1-X6, J-4, A20, U6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import parsing as P
from quillspark.functions import text as T
from quillspark.models import Models
from quillspark.operators.matching import Needles
from quillspark.operators.ranking import first_per
from quillspark.shipping import ship
from quillspark.staging import stage

#: Pairs of entities in one batch.
PAIRS = 1 << 16


def entities(docs: DataFrame, recognise) -> DataFrame:
    """(doc_id, name, label), the first of each lower-cased name and label."""
    found = docs.select("doc_id", F.posexplode(recognise(F.col("text"))).alias("pos", "e"))
    flat = found.select("doc_id", "pos", F.col("e.text").alias("name"), F.col("e.label").alias("label"))
    return first_per(flat.withColumn("_k", F.lower("name")), ["doc_id", "_k", "label"], [F.col("pos")]).drop("_k", "pos")


def cooccurring(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct (doc_id, src, dst, rel) with src <= dst for entities named in one sentence.

    A document's entities meet its sentences in one row. Each sentence is looked through once for the beginnings of the
    entities' names, and only names whose beginning it has are tested. A document's pairs are made distinct in its task, a
    run of its first entities at a time, so pairs are not shuffled and a batch of them is of bounded size.
    """
    ship(docs.sparkSession)
    names = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Lower case is Spark's, as everywhere else. Rows of one id are one document.
    texts = docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    sentences = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, r"(?<=[.!?])\s+", -1), F.lower)))
    s = texts.join(names, "doc_id").select("doc_id", "names", F.transform("names", F.lower).alias("low"), sentences.alias("sentences"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, low = batch.column(1)[i].values, batch.column(2)[i].as_py()
                always = [j for j, x in enumerate(low) if not x]
                sought = Needles(low, [j for j, x in enumerate(low) if x])
                here = [np.array(sorted([*always, *sought.inside(x)]), np.int64) for x in batch.column(3)[i].as_py()]
                # Of each entity what follows it in a sentence: views of the sentences' own lists.
                begun: dict[int, list[np.ndarray]] = {}
                for h in here:
                    for at in range(len(h) - 1):
                        begun.setdefault(int(h[at]), []).append(h[at + 1 :])
                doc = batch.column(0).slice(i, 1)
                held, n = [], 0
                for first in sorted(begun):
                    after = np.unique(np.concatenate(begun.pop(first)))
                    held.append((first, after))
                    n += len(after)
                    if n >= PAIRS:
                        yield _pairs(doc, names, held)
                        held, n = [], 0
                if held:
                    yield _pairs(doc, names, held)

    return s.mapInArrow(each, f"doc_id {kind}, src string, dst string").select("doc_id", "src", "dst", F.lit("ASSOCIATED_WITH").alias("rel"))


def _pairs(doc: pa.Array, names: pa.Array, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """One document's pairs of the entities at these places."""
    size = [len(x) for _, x in held]
    a, b = np.repeat([x for x, _ in held], size), np.concatenate([x for _, x in held])
    return pa.RecordBatch.from_arrays([doc.take(pa.array(np.zeros(len(a), np.int64))), names.take(pa.array(a)), names.take(pa.array(b))], names=["doc_id", "src", "dst"])


def relations(answers: DataFrame, found: DataFrame, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """J-4: answers (doc_id, idx, answer) to (relations, dropped names).

    Relations have both ends among the document's entities (after T19) and an allowed type; the first of each lower-
    cased triple stays. Dropped: (doc_id, name) of ends that are no entity.
    """
    raw = answers.select("doc_id", "idx", F.posexplode(P.parsed_relations("answer")).alias("pos", "r")).select(
        "doc_id", "idx", "pos", T.entity_name(F.col("r.source")).alias("source"), T.entity_name(F.col("r.target")).alias("target"),
        F.col("r.type").alias("type"), F.col("r.confidence").alias("confidence"),
    )
    known = found.select("doc_id", "name").withColumn("norm", T.entity_name(F.col("name")))
    known = known.groupBy("doc_id", "norm").agg(F.min("name").alias("name"))
    s = known.select("doc_id", F.col("norm").alias("source"), F.col("name").alias("source_name"))
    d = known.select("doc_id", F.col("norm").alias("target"), F.col("name").alias("target_name"))
    full = raw.join(s, ["doc_id", "source"], "left").join(d, ["doc_id", "target"], "left")
    ok = full.where("source_name is not null and target_name is not null")
    if types:
        ok = ok.where(F.col("type").isin(types))
    key = ["doc_id", "_s", "_t", "_d"]
    ok = ok.withColumns({"_s": F.lower("source_name"), "_t": F.lower("type"), "_d": F.lower("target_name")})
    kept = first_per(ok, key, [F.col("idx"), F.col("pos")]).select(
        "doc_id", "source_name", "target_name", F.col("type").alias("relation_type"), "confidence"
    )
    lost = full.where("source_name is null or target_name is null")
    names = F.array(F.when(F.col("source_name").isNull(), F.col("source")), F.when(F.col("target_name").isNull(), F.col("target")))
    dropped = lost.select("doc_id", F.explode(names).alias("name")).where("coalesce(name, '') <> ''").distinct()
    return kept, dropped


def merge_windows(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each lower-cased key over a document's windows."""
    low = rows.withColumns({f"_k{i}": F.lower(F.col(k)) for i, k in enumerate(key)})
    names = [f"_k{i}" for i in range(len(key))]
    return first_per(low, ["doc_id", *names], [F.col("idx"), F.col("pos")]).drop(*names)


def fallback_types(dropped: DataFrame, classify, allowed: list[str]) -> DataFrame:
    """Names that were dropped, with the allowed type a classifier gives; others go."""
    return dropped.withColumn("type", classify(F.col("name"))).where(F.col("type").isin(allowed)).withColumn(
        "discovered_by", F.lit("llm_fallback")
    )


def entities_in_slices(docs: DataFrame, recognise, size: int = C.SLICE_WORDS) -> DataFrame:
    """(doc_id, ord, name, label): entities of a text's slices of ``size`` words, the first of each lower-cased name
    and label. A text of no more words is recognised as it is; longer ones have one space between words."""
    words = F.filter(F.split("text", r"\s+", -1), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.explode(F.array(words)).alias("words"))  # split once, not once a slice
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(size))
    slices = F.when(F.size("words") <= size, F.array("text")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, F.lit(size)), " ")))
    spans = cut.where("size(words) > 0").select("doc_id", F.posexplode(slices).alias("idx", "slice")).select("doc_id", "idx", F.posexplode(recognise(F.col("slice"))).alias("pos", "e"))
    flat = spans.select("doc_id", F.struct("idx", "pos").alias("ord"), T.strip(F.col("e.text")).alias("name"), F.col("e.label").alias("label")).where("name <> ''")
    return first_per(flat.withColumn("_k", F.lower("name")), ["doc_id", "_k", "label"], [F.col("ord")]).select("doc_id", "ord", "name", "label")


def whole_document(docs: DataFrame, answer: Column, recognise=None) -> tuple[DataFrame, DataFrame]:
    """X5, J-1, J-3: nodes (doc_id, id, type, discovered_by) and edges (doc_id, source, target, type) of an answer. With a
    recogniser, docs (with their text) whose answer can't be parsed fall back to entities named in one sentence (X2)."""
    obj = P.with_json_object(docs.select("doc_id", answer.alias("_answer")), "_answer", "o").select("doc_id", "o")
    nodes = obj.select("doc_id", F.explode(P.normal_nodes(F.col("o"))).alias("n")).select("doc_id", "n.*")
    edges = obj.select("doc_id", F.explode(P.normal_edges(F.col("o"))).alias("e")).select("doc_id", "e.*")
    if recognise is None:
        return nodes, edges
    read = P.with_json_object(docs.select("doc_id", "text", answer.alias("_answer")), "_answer", "_o")
    rest = stage(read.where("_o is null").select("doc_id", "text"), "broken")
    found = stage(entities_in_slices(rest, recognise), "entities")
    more = found.select("doc_id", F.col("name").alias("id"), F.col("label").alias("type"), F.lit("cooccurrence").alias("discovered_by"))
    pairs = cooccurring(rest, found).select("doc_id", F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel").alias("type"))
    return nodes.unionByName(more, allowMissingColumns=True), edges.unionByName(pairs, allowMissingColumns=True)


@dataclass(frozen=True)
class Extraction:
    """nodes (doc_id, name, type, discovered_by), edges (doc_id, source_name, target_name, relation_type, confidence) and the
    audit of dropped names (doc_id, name, inferred_type, method), for a log (K12) and for label promotion (A19)."""

    nodes: DataFrame
    edges: DataFrame
    audit: DataFrame


def hybrid(
    docs: DataFrame, models: Models, ask: Callable[[Column], Column], types: list[str] | None = None, classify: Callable[[Column], Column] | None = None,
    allowed: list[str] | None = None, second_pass: bool = True, most: int = C.LLM_WINDOW_WORDS, overlap: int = C.LLM_WINDOW_OVERLAP,
) -> Extraction:
    """Recognised entities, relations of each window by the language model, and what these name but the
    recogniser missed.

    Names that relations were dropped for are typed by ``classify``; those of an allowed type are entities too, marked as
    found by the fallback, and with ``second_pass`` the windows are asked again with them in the prompt. Relations of the
    first pass come first; the second adds those it lacks. Without a classifier there is one pass, and the audit has the
    names without a type. Each stage is a staged table, so a model answers once.
    """
    from quillspark.operators.documents import per_window

    # Summaries are made once, so the window before goes to no join.
    summary = F.when(F.col("previous").isNotNull(), models.summarise(F.col("previous")))
    w = stage(per_window(docs, most, overlap).select("doc_id", "idx", "window", summary.alias("summary")), "windows")
    found = stage(entities_in_slices(docs, models.recognise), "entities")

    def related(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        lists = known.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
        asked = w.join(lists, "doc_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        answers = asked.select("doc_id", "idx", ask(T.window_prompt(F.col("window"), F.col("summary"), F.array_distinct("names"), types or [])).alias("answer"))
        return relations(stage(answers, "answers"), known, types)

    edges, dropped = related(found)
    dropped = stage(dropped, "dropped")
    nodes = found.withColumn("discovered_by", F.lit(None).cast("string"))
    if classify is None:
        audit = dropped.select("doc_id", "name", F.lit(None).cast("string").alias("inferred_type"), F.lit("dropped").alias("method"))
    else:
        typed = stage(fallback_types(dropped, classify, allowed or []), "typed")
        known = found.select("doc_id", F.lower("name").alias("_k")).distinct()
        new = typed.withColumn("_k", F.lower("name")).join(known, ["doc_id", "_k"], "left_anti")
        new = first_per(new, ["doc_id", "_k"], [F.col("name")])
        last = F.struct(F.lit(2**31 - 1).alias("idx"), F.lit(0).alias("pos"))
        new = stage(new.select("doc_id", last.alias("ord"), "name", F.col("type").alias("label"), "discovered_by"), "recovered")
        nodes = nodes.unionByName(new)
        method = F.when(F.col("discovered_by").isNull(), "dropped").otherwise(F.col("discovered_by"))
        audit = dropped.join(typed, ["doc_id", "name"], "left").select("doc_id", "name", F.col("type").alias("inferred_type"), method.alias("method"))
        if second_pass:
            again = docs.join(new.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")
            more, _ = related(nodes.drop("discovered_by").join(again.distinct(), "doc_id", "left_semi"))
            key = ["doc_id", "source_name", "relation_type", "target_name"]
            edges = edges.unionByName(more.join(edges.select(*key), key, "left_anti").select(edges.columns))
    return Extraction(nodes.select("doc_id", "name", F.col("label").alias("type"), "discovered_by"), edges, audit)


def by_windows(docs: DataFrame, models: Models, ask, types: list[str] | None = None, most: int = C.LLM_WINDOW_WORDS, overlap: int = C.LLM_WINDOW_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a document from its windows. ``ask`` maps a Column of prompts to answers.

    Each window's prompt has the summary of the window before it, and the entities of the window itself. An entity keeps
    its recogniser's label; one name with several labels is several entities (T10).
    """
    from quillspark.operators.documents import per_window

    w = per_window(docs, most, overlap)
    spans = models.recognise(F.col("window"))
    w = w.withColumns({"spans": spans, "names": F.array_distinct(F.transform(spans, lambda e: e["text"]))})
    summary = F.when(F.col("previous").isNotNull(), models.summarise(F.col("previous")))
    prompt = T.window_prompt(F.col("window"), summary, F.col("names"), types or [])
    found = w.select("doc_id", "idx", F.posexplode("spans").alias("pos", "e")).select("doc_id", "idx", "pos", F.col("e.text").alias("name"), F.col("e.label").alias("label"))
    found = merge_windows(found, ["name", "label"])
    kept, _ = relations(w.select("doc_id", "idx", ask(prompt).alias("answer")), found, types)
    return found.select("doc_id", "name", "label"), kept
