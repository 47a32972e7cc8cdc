"""Line dedup: lines that many documents hold stay in one of them.

Texts are split at line breaks and exploded into lines with their positions. A line's key is the line without white
space at its ends and with A-Z in lower case; its MD5 stands for it. Keys of at least ``least_chars`` code points that
at least ``least_docs`` documents hold are frequent, and are dropped from every document but the one with the largest
doc_id. The lines left are put together again by position.

Lines travel as digest, document and position; texts are shuffled once, to the positions that are dropped from them.
Digests are counted with sums in each task first, which leaves the few that as many lines have; their distinct
documents are counted by (digest, document) and then by digest, so no task gathers a frequent line's documents. Joins of
lines with frequent digests have one row a digest on their small side, and adaptive execution splits the other.

Defined cases: a null or empty text is one empty line (a null text stays null). A document is a doc_id, so rows of equal
doc_id are one document, and all of them keep the lines that it keeps; rows without an id are a document for each
distinct text, never keep a frequent line that a document with an id holds, and keep it where none has an id. A line
repeated in the document that keeps it stays as often. Lines below ``least_chars`` always stay. Empty tables give empty
results; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, free_name, guard, stage

LEAST_DOCS, LEAST_CHARS = 5, 40
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is much the faster one, and the same where all is ASCII.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def _texts(docs: DataFrame) -> DataFrame:
    """docs with what stands for a row: rows that are alike in doc_id, _hash and _bytes have the same lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_text": text, "_hash": F.xxhash64(text), "_bytes": F.octet_length(text)})


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, _hash, _bytes, pos, key) of each line that is long enough."""
    lines = _texts(docs.select("doc_id", "text")).select(
        "doc_id", "_hash", "_bytes", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line")
    )
    long = lines.where(F.length(F.btrim("line", F.lit(BLANKS))) >= least_chars)
    return long.select("doc_id", "_hash", "_bytes", "pos", F.unhex(F.md5(line_key(F.col("line")))).alias("key"))


def _held(docs: DataFrame, least_docs: int, least_chars: int) -> tuple[DataFrame, DataFrame]:
    """The lines whose key so many lines have, staged, and (key, n_docs, keeper) of the keys that so many documents have."""
    lines = _lines(docs, least_chars)
    often = stage(lines.groupBy("key").count().where(F.col("count") >= least_docs).select("key"), "often")
    held = stage(lines.join(often, "key"), "held")
    alone = F.col("doc_id").isNull()
    by = held.select("key", "doc_id", F.when(alone, F.col("_hash")).alias("h"), F.when(alone, F.col("_bytes")).alias("b")).distinct()
    counts = by.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return held, stage(counts.where(F.col("n_docs") >= least_docs), "frequent")


def frequent_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, n_docs, keeper): MD5 of each frequent line's key, its documents, and the doc_id that keeps it."""
    return _held(docs, least_docs, least_chars)[1]


def line_dedup(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with the lines left in text, and n_lines (before) and n_dropped (under free names, see ``free_name``)."""
    plain, _ = guard(docs, ("doc_id", "text"))
    held, frequent = _held(plain, least_docs, least_chars)
    other = F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    dropped = held.join(frequent, "key").where(other)
    dropped = dropped.groupBy("doc_id", "_hash", "_bytes").agg(F.collect_set("pos").alias("_dropped")).toDF("_d", "_h", "_b", "_dropped")
    texts = _texts(plain)
    same = texts["doc_id"].eqNullSafe(dropped["_d"]) & (texts["_hash"] == dropped["_h"]) & (texts["_bytes"] == dropped["_b"])
    # By hint, so that texts are shuffled or not whatever the size: cost stays proportional.
    rows = texts.join(dropped.hint("merge"), same, "left")
    # An exploded array of one: lines are split once a text, not once a line that is put back.
    rows = rows.withColumn("_lines", F.explode(F.array(F.split("_text", "\n", -1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    text = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    out = {c: F.col(c) for c in plain.columns} | {"text": F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(text)}
    counts = [F.size("_lines").cast("long"), F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long")]
    names = [free_name(docs, "n_lines"), free_name(docs, "n_dropped")]
    return rows.select(*[x.alias(f"_c{i}") for i, x in enumerate([*out.values(), *counts])]).toDF(*docs.columns, *names)
