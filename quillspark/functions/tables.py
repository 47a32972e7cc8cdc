"""

Chunkers and retrievers have bodies in SQL, so Catalyst inlines them where they are called with LATERAL: no Python runs,
and filters and columns reach the scan. A text of null has no chunk. ``ranked_hits`` is a Python table function over a
table argument; it declares by itself that a question's hits come together and in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from quillspark import constants as C
from quillspark.functions.text import BLANK


def _quoted(value: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" if c in "'\\" or ord(c) < 32 else c for c in value) + "'"


def _starts(n: str, width: str, step: str) -> str:
    """Beginnings of windows; the last window is the one that reaches the end."""
    return f"filter(sequence(0, greatest({n} - 1, 0), {step}), i -> i = 0 OR i - {step} + {width} < {n})"


_WORDS = r"filter(split(text, '\\s+', -1), x -> x <> '')"

#: name: (arguments, array of chunks)
CHUNKERS = {
    "sentence_rows": (
        "text STRING",
        f"filter(transform(split(text, {_quoted(C.SENTENCE_BREAK)}, -1), s -> btrim(s, {_quoted(BLANK)})), s -> s <> '')",
    ),
    "fixed_chunks": (
        f"text STRING, size INT DEFAULT {C.CHUNK_SIZE}, overlap INT DEFAULT {C.CHUNK_OVERLAP}",
        f"flatten(transform(array(length(text)), n -> filter(transform({_starts('n', 'greatest(1, size * 4)', 'greatest(1, (size - overlap) * 4)')}, "
        f"i -> btrim(substr(text, i + 1, greatest(1, size * 4)), {_quoted(BLANK)})), c -> c <> '')))",
    ),
    # words are bound to w once: named inside the inner lambda they would be cut again for every window
    "word_windows": (
        f"text STRING, width INT DEFAULT {C.WORD_WINDOW}, step INT DEFAULT {C.WORD_STEP}",
        f"flatten(transform(filter(array({_WORDS}), w -> size(w) > 0), w -> transform({_starts('size(w)', 'width', 'step')}, "
        f"i -> array_join(slice(w, i + 1, width), ' '))))",
    ),
}


class RankedHits:
    """``ranked_hits(TABLE(hits), k)``: of each ``qid`` the first k rows by falling ``score``, then ``arrival``, with ``rank``.

    Rows after the k-th are not read by Python. Null scores come last. Hits of a question are what its retrievers
    returned, so their number is bounded by the retrievers' k; for whole tables use a window with a rank limit.
    """

    def __init__(self) -> None:
        self._n = 0

    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        if not hits.isTable:
            raise ValueError("ranked_hits needs a table: TABLE(hits)")
        if not k.isConstantExpression or not isinstance(k.value, int) or k.value < 1:
            raise ValueError("ranked_hits needs a constant k of 1 or more")
        if missing := {"qid", "score", "arrival"} - set(hits.dataType.names):
            raise ValueError(f"ranked_hits needs the columns {sorted(missing)}")
        if "rank" in hits.dataType.names:
            raise ValueError("ranked_hits adds rank, which the table has already")
        schema = StructType(list(hits.dataType.fields)).add("rank", LongType())
        order = [OrderingColumn("score", ascending=False, overrideNullsFirst=False), OrderingColumn("arrival")]
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("qid")], orderBy=order)

    def eval(self, hits: Row, k: int):
        if self._n >= k:
            raise SkipRestOfInputTableException("the first k are out")
        self._n += 1
        yield (*hits, self._n)


def register(spark: SparkSession) -> None:
    """Chunkers and ``ranked_hits`` as temporary functions of the session; again has no effect on results."""
    for name, (arguments, parts) in CHUNKERS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE (chunk_idx INT, chunk STRING) "
            f"RETURN SELECT p.pos, p.col FROM LATERAL posexplode({parts}) p"
        )
    spark.udtf.register("ranked_hits", F.udtf(RankedHits))


def register_retriever(spark: SparkSession, name: str, facts: DataFrame, k: int) -> None:
    """A retriever in SQL: ``name(subject)`` gives the k heaviest (fact, weight, rank) of a subject, ties by fact.

    ``facts`` has (subject string, fact string, weight double). Called with LATERAL for a table of questions it is one
    join with a rank limit, which drops a hot subject's rows before they are shuffled for the ranking.
    """
    facts.select("subject", "fact", F.col("weight").cast("double").alias("weight")).createOrReplaceTempView(f"{name}_facts")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(asked STRING) RETURNS TABLE (fact STRING, weight DOUBLE, rank BIGINT) "
        f"RETURN SELECT f.fact, f.weight, f.n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY weight DESC, fact) AS BIGINT) AS n "
        f"FROM {name}_facts) f WHERE f.subject = asked AND f.n <= {int(k)}"
    )


def drop_retriever(spark: SparkSession, name: str) -> None:
    """Results that were made before stay as they are: their plans hold the function's body."""
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
    spark.catalog.dropTempView(f"{name}_facts")
