
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.operators.ranking import first_per, global_rank
from quillspark.shipping import ship


def chunks(docs: DataFrame, strategy: str = "sentence", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """A row (other columns, chunk_idx, chunk) for each chunk."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(T.chunk(F.col(text), strategy, size, overlap)).alias("chunk_idx", "chunk"))


def reconstruct(pieces: DataFrame) -> DataFrame:
    """A10: each document's chunks in order, joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk")))
    return pieces.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.array_join(F.transform(parts, lambda x: x["chunk"]), "\n\n").alias("text")
    )


def listing(pieces: DataFrame, *firsts: str) -> DataFrame:
    """Chunks of each document, and columns of its first one."""
    return pieces.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), *[F.min_by(c, "chunk_idx").alias(c) for c in firsts]
    )


def counts(pieces: DataFrame, collection: str) -> DataFrame:
    """A11."""
    return pieces.groupBy(collection).agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Texts that several documents have, with the smallest id and their number."""
    keyed = docs.select("doc_id", T.checksum(F.col("text")).alias("checksum"))
    return (
        keyed.groupBy("checksum").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs")).where("n_docs > 1")
    )


def first_chunks(pieces: DataFrame) -> DataFrame:
    """Each document's first chunk, one a document (the smallest text where several are numbered 0)."""
    return first_per(pieces.where("chunk_idx = 0"), ["doc_id"], [F.col("text")])


def stride_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """N rows at even strides. Only the ordering column is ranked; the number of rows is a count, not a gather."""
    total = rows.count()
    if total <= n:
        return rows
    wanted = [int(i * (total / n)) + 1 for i in range(n)]
    return global_rank(rows, [order], "_nth").where(F.col("_nth").isin(wanted)).drop("_nth")


def golden_pairs(docs: DataFrame) -> DataFrame:
    """A question and its truth for every document."""
    return docs.select(
        "doc_id",
        T.golden_question(F.col("doc_id").cast("string")).alias("question"),
        T.golden_truth(F.col("text")).alias("ground_truth"),
    )


def entity_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and edges that name each document as a source."""
    n = nodes.select(F.explode("source_docs").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    e = edges.select(F.explode("source_docs").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    return n.join(e, "doc_id", "full").select(
        "doc_id", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_edges", F.lit(0)).alias("n_edges")
    )


def per_window(docs: DataFrame, most: int = C.LLM_WINDOW_WORDS, overlap: int = C.LLM_WINDOW_OVERLAP) -> DataFrame:
    """Sentence windows, each with the window before it (null for the first), taken in the row: nothing is shuffled."""
    ship(docs.sparkSession)
    cut = docs.select("doc_id", T.windows_of_sentences(F.col("text"), most, overlap).alias("windows"))
    pairs = F.transform("windows", lambda x, i: F.struct(x.alias("window"), F.when(i > 0, F.get("windows", i - 1)).alias("previous")))
    return cut.select("doc_id", F.posexplode(pairs).alias("idx", "w")).select("doc_id", "idx", "w.window", "w.previous")
