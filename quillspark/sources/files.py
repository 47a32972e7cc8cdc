"""Sources: directories of text, tables in CSV and JSON, golden rows, generated transactions, linked pages."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.operators.ranking import first_per, global_rank
from quillspark.operators.sync import decoded, ignored
from quillspark.staging import stage


def relative(path_column: str, root: str):
    """The path below root, whatever scheme it is listed with."""
    tail = root.rstrip("/").split("://")[-1]
    return F.regexp_replace(F.col(path_column), r"^[a-z]+:/*.*?" + "\\Q" + tail.lstrip("/") + "\\E/", "")


def scan(spark: SparkSession, root: str, suffixes: list[str] | None = None, ignore: list[str] = (), recursive: bool = True) -> DataFrame:
    """(rel_path, text, checksum) of a folder's text files, one row a file; ignored and undecodable ones go."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        .select(relative("path", root).alias("rel_path"), "length", "content")
    )
    if suffixes:
        raw = raw.where(F.lower("rel_path").rlike("(" + "|".join("\\Q" + s + "\\E" for s in suffixes) + ")$"))
    if not recursive:
        raw = raw.where(~F.contains("rel_path", F.lit("/")))
    return decoded(raw.where(~ignored(F.col("rel_path"), list(ignore))))


def batch_documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text): doc_id is the file's stem."""
    files = scan(spark, root, C.BATCH_SUFFIXES, recursive=False)
    return files.select(F.regexp_replace("rel_path", r"\.[^./]+$", "").alias("doc_id"), "text", "checksum")


def corpus_documents(spark: SparkSession, root: str, source: str) -> DataFrame:
    """(doc_id, text) of .md files but README.md; doc_id is source::path::parts."""
    files = scan(spark, root, [".md"]).where(~F.col("rel_path").rlike(r"(^|/)README\.md$"))
    stem = F.regexp_replace("rel_path", r"\.md$", "")
    return files.select(F.concat(F.lit(f"{source}::"), F.replace(stem, F.lit("/"), F.lit("::"))).alias("doc_id"), "text", "checksum")


def transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """All strings but the amount, 0 where it is no number."""
    names = ["txn_id", "from", "to", "amount", "device", "card"]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=False)
    return raw.withColumn("amount", F.coalesce(F.expr("try_cast(amount as double)"), F.lit(0.0)))


def transactions_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, under any of their key names."""
    schema = "id string, txn_id string, src string, `from` string, dst string, `to` string, amount string, device string, card string"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(
        F.coalesce("txn_id", "id").alias("txn_id"), F.coalesce("from", "src").alias("from"), F.coalesce("to", "dst").alias("to"),
        F.coalesce(F.expr("try_cast(amount as double)"), F.lit(0.0)).alias("amount"), "device", "card",
    )


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Question, ground_truth, answer, contexts, doc_id from a JSON list."""
    schema = "question string, ground_truth string, answer string, contexts array<string>, doc_id string"
    return spark.read.schema(schema).json(path, multiLine=True)


def pdf_text(files: DataFrame, convert) -> DataFrame:
    """PDF contents through a converter given as a function of bytes (none comes with the library)."""
    @F.pandas_udf("string")
    def to_text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: convert(bytes(b)) if b is not None else None)

    return files.withColumn("text", to_text("content"))


def generated_transactions(spark: SparkSession, benign: int = 470, seed: int = 42) -> DataFrame:
    """A fixture: benign rows and five patterns (a shared device, rapid cycling, a large amount, a shared card, a
    mule)."""
    r = random.Random(seed)
    rows = [
        (f"t{i}", f"acct{r.randrange(60)}", f"acct{r.randrange(60)}", round(r.uniform(5, 500), 2), f"dev{i % 97}", f"card{i % 89}")
        for i in range(benign)
    ]
    more = [(a, b, 900.0, "D1", f"c{a}") for a, b in (("alpha", "beta"), ("beta", "gamma"), ("gamma", "alpha"))]
    more += [("rapid", f"acct{i}", 9.5, "D7", "K7") for i in range(20)]
    more += [("whale", "acct1", 99999.0, "D8", "K8"), ("zeta", "acct2", 40.0, "D5", "K9"), ("eta", "acct3", 41.0, "D6", "K9")]
    more += [("victim", "mule", 5000.0, "D3", "K3"), ("mule", "cashout", 4950.0, "D4", "K4")]
    rows += [(f"p{i}", *x) for i, x in enumerate(more)]
    return spark.createDataFrame(rows, "txn_id string, `from` string, `to` string, amount double, device string, card string")


def frontier(seeds: DataFrame, links: DataFrame, pages: DataFrame, limit: int, least_chars: int = 200, per_page: int = 50) -> DataFrame:
    """Breadth-first (title, text, depth, ord): from seeds (title, ord) over links (title, target, pos).

    A title is popped once, in the order of its queue; ``limit`` counts popped titles, also those that have no page or
    too short a text (which return with a null text and lead nowhere). Levels go on until the limit or the last link.
    """
    done = None
    level = seeds.groupBy("title").agg(F.min("ord").cast("double").alias("ord"))
    popped, depth = 0, 0
    text = pages.where(F.length("text") > least_chars).select("title", "text")
    out = links.where(F.col("pos") < per_page)
    while popped < limit:
        level = global_rank(level, ["ord", "title"], "_n").where(F.col("_n") <= limit - popped)
        level = level.select("title", (F.col("_n") + popped).alias("ord"), F.lit(depth).alias("depth")).join(text, "title", "left")
        level = stage(level.select("title", "text", "depth", "ord"), "level")
        n = level.count()
        if not n and done is not None:
            break
        done = level if done is None else done.unionByName(level)
        if not n:
            break
        popped, depth = popped + n, depth + 1
        nxt = level.where("text is not null").join(out, "title").select(F.col("target").alias("title"), "ord", "pos")
        nxt = nxt.join(done.select("title"), "title", "left_anti")
        first = first_per(nxt, ["title"], [F.col("ord"), F.col("pos")])
        level = first.select("title", (F.col("ord").cast("double") + F.col("pos") / 1e6).alias("ord"))
    return done
