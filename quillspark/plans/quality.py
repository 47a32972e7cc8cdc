"""Queries that measure: retrieval and answer metrics, labels, latency; parsed model output; event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import parsing as P
from quillspark.functions import text as T
from quillspark.functions.vectors import cosine, hash_embed
from quillspark.models import gazetteer
from quillspark.operators import evaluation as E
from quillspark.operators import extraction as X
from quillspark.operators import labels, metrics
from quillspark.operators.search import top_k
from quillspark.plans.registry import BLANKS, query, strings, table, tok, words
from quillspark.streaming import sync as streams

_STOP = strings(C.ANSWER_STOPWORDS)


def _terms(text: str) -> str:
    return f"list_filter(list_distinct({tok(text)}), lambda x: NOT list_contains({_STOP}, x))"


# Answers are assistant turns; their contexts the two turns before; the truth is the turn's own first words.
_TALK = "t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS p1, lag(text, 2) OVER w AS p2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), a AS (SELECT conv_id, turn, p1 AS question, text AS answer, list_filter([p1, p2], lambda x: x IS NOT NULL) AS ctx FROM t WHERE role = 'assistant')"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("p1"), F.lag("text", 2).over(w).alias("p2"))
    return c.where("role = 'assistant'").select(
        "conv_id", "turn", F.col("p1").alias("question"), F.col("text").alias("answer"), F.array_compact(F.array("p1", "p2")).alias("ctx")
    )


_EVAL_SENTS = (
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(answer, @B@), '\b(e\.g|i\.e|etc|Dr|Mr|Ms|vs)\.', '\1<DOT>', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), "
    r"lambda s: replace(s, '<DOT>', '.')), lambda s: trim(s, @B@) <> '')"
).replace("@B@", BLANKS)


@query(
    f"""
    WITH {_TALK}, x AS (SELECT conv_id, turn, answer, {_EVAL_SENTS} AS s, list_distinct(flatten(list_transform(ctx, lambda c: {_terms("c")}))) AS known FROM a),
    y AS (SELECT conv_id, turn, answer, s, list_filter(s, lambda z: len({_terms("z")}) > 0 AND len(list_intersect({_terms("z")}, known)) / len({_terms("z")}) >= 0.5) AS ok FROM x)
    SELECT conv_id, turn, CASE WHEN trim(answer, {BLANKS}) = '' THEN 0.0 WHEN len(list_filter({strings(C.ABSTENTIONS)}, lambda p: contains(lower(answer), p))) > 0 THEN 1.0
        WHEN len(s) = 0 THEN 0.0 ELSE round(len(ok) / len(s), 6) END::DOUBLE AS faithfulness FROM y
    """
)
def eval_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return a.select("conv_id", "turn", F.round(E.faithfulness(F.col("answer"), F.col("ctx")), 6).alias("faithfulness"))


#: Each item's truth against a batch of documents: those that share its number modulo the number of items.
_PAIRS = "n AS (SELECT count(*) AS n FROM benchmark), pairs AS (SELECT item_id, b.text AS truth, d.doc_id, d.text AS ctx FROM documents d JOIN n ON true JOIN benchmark b ON b.item_id = d.doc_id % n)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    n = b.count()
    return d.select("doc_id", F.col("text").alias("ctx"), (F.col("doc_id") % n).alias("item_id")).join(
        b.select("item_id", F.col("text").alias("truth")), "item_id"
    )


@query(
    rf"""
    WITH {_PAIRS}, t AS (SELECT item_id, doc_id, list_distinct(regexp_extract_all(lower(truth), '[\p{{L}}\p{{N}}_]{{2,}}')) AS t, list_distinct(regexp_extract_all(lower(ctx), '[\p{{L}}\p{{N}}_]{{2,}}')) AS c FROM pairs)
    SELECT item_id, doc_id, round(len(list_intersect(t, c)) / len(t), 6) AS recall FROM t
    """
)
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("item_id", "doc_id", F.round(E.recall(F.col("truth"), F.array("ctx")), 6).alias("recall"))


@query(
    f"""
    WITH {_PAIRS}, t AS (SELECT item_id, doc_id, list_distinct({tok("truth")}) AS t, list_distinct({tok("ctx")}) AS c FROM pairs),
    j AS (SELECT item_id, doc_id, len(list_intersect(t, c)) / greatest(len(list_distinct(list_concat(t, c))), 1) AS j FROM t WHERE len(t) > 0)
    SELECT item_id, doc_id, round(j, 6) AS jaccard, CASE WHEN j < 0.01 THEN 'LOW' WHEN j < 0.03 THEN 'MARGINAL' ELSE 'OK' END AS verdict FROM j
    """
)
def golden_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).withColumn("j", E.jaccard(F.col("truth"), F.array("ctx"))).where("j is not null")
    return p.select("item_id", "doc_id", F.round("j", 6).alias("jaccard"), E.retrievability(F.col("j")).alias("verdict"))


_LONG = r"regexp_extract_all(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '[^ ]{{4,}}')"


@query(
    rf"""
    WITH {_TALK}, q AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'What does the ' || {words("answer")}[1] || ' document describe?' ELSE question END AS question, answer || CASE WHEN turn % 2 = 0 THEN ' port 80' ELSE ' It uses a pipeline.' END AS answer FROM a),
    x AS (SELECT *, regexp_extract(lower(question), 'what does the (.+?) (document|file|note|md) describe', 1) AS name FROM q)
    SELECT conv_id, turn, round((CASE WHEN coalesce(name, '') <> '' THEN contains(lower(answer), trim(name)) ELSE len(list_intersect({_LONG.format("question")}, {_LONG.format("answer")})) > 0 END::INT
        + (len(list_filter({strings(C.PURPOSES)}, lambda p: contains(lower(answer), p))) > 0)::INT + regexp_matches(regexp_replace(answer, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '(^| )\d+( |$)')::INT) / 3, 6) AS relevancy
    FROM x WHERE question IS NOT NULL
    """
)
def eval_decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, with a template question for each third turn and an answer that has a number or a purpose."""
    a = _answers(spark, sf_dir)
    first = F.regexp_extract_all("answer", F.lit(r"\S+"), F.lit(0))[0]
    q = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("What does the "), first, F.lit(" document describe?"))).otherwise(F.col("question"))
    answer = F.concat("answer", F.when(F.col("turn") % 2 == 0, " port 80").otherwise(" It uses a pipeline."))
    a = a.select("conv_id", "turn", q.alias("question"), answer.alias("answer")).where("question is not null")
    return a.select("conv_id", "turn", F.round(E.decomposed_relevancy(F.col("question"), F.col("answer")), 6).alias("relevancy"))


_BIN = "('0x' || substr(md5(t), 7, 2) || substr(md5(t), 5, 2) || substr(md5(t), 3, 2) || substr(md5(t), 1, 2))::BIGINT % 64"


@query(
    f"""
    WITH {_TALK}, x AS (SELECT conv_id, turn, 'q' AS k, unnest({tok("question")}) AS t FROM a UNION ALL SELECT conv_id, turn, 'a', unnest({tok("answer")}) FROM a),
    v AS (SELECT conv_id, turn, {_BIN} AS b, count(*) FILTER (WHERE k = 'q') AS q, count(*) FILTER (WHERE k = 'a') AS a FROM x GROUP BY 1, 2, 3),
    c AS (SELECT conv_id, turn, sum(q * a) / (sqrt(sum(q * q)) * sqrt(sum(a * a))) AS c FROM v GROUP BY 1, 2)
    SELECT conv_id, turn, round(CASE WHEN isfinite(c) THEN c ELSE 0 END, 6) AS relevancy FROM c JOIN a USING (conv_id, turn) WHERE question IS NOT NULL
    """
)
def eval_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 with the hashing embedder."""
    a = _answers(spark, sf_dir).where("question is not null")
    vec = a.select("conv_id", "turn", hash_embed(F.col("question")).alias("q"), hash_embed(F.col("answer")).alias("a"))
    return vec.select("conv_id", "turn", F.round(F.greatest(F.lit(0.0), cosine(F.col("q"), F.col("a"))), 6).alias("relevancy"))


@query(
    f"""
    WITH {_TALK}, x AS (SELECT conv_id, turn, 0 AS i, unnest({tok("answer")}) AS t FROM a UNION ALL SELECT conv_id, turn, i, unnest({tok("c")}) FROM (SELECT conv_id, turn, unnest(ctx) AS c, unnest(range(1, len(ctx) + 1)) AS i FROM a)),
    v AS (SELECT conv_id, turn, i, {_BIN} AS b, count(*) AS n FROM x GROUP BY 1, 2, 3, 4), l AS (SELECT conv_id, turn, i, sqrt(sum(n * n)) AS l FROM v GROUP BY 1, 2, 3),
    d AS (SELECT y.conv_id, y.turn, y.i, sum(y.n * z.n) AS d FROM v y JOIN v z ON y.conv_id = z.conv_id AND y.turn = z.turn AND y.b = z.b AND z.i = 0 AND y.i > 0 GROUP BY 1, 2, 3),
    c AS (SELECT d.conv_id, d.turn, d.i, round(d / (p.l * q.l), 9) AS c FROM d JOIN l p USING (conv_id, turn, i) JOIN l q ON q.conv_id = d.conv_id AND q.turn = d.turn AND q.i = 0)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(ctx) = 0 THEN 0 ELSE coalesce(h, 0) / len(ctx) END, 6)::DOUBLE AS precision FROM a LEFT JOIN (SELECT conv_id, turn, count(*) AS h FROM c WHERE c >= 0.35 GROUP BY 1, 2) USING (conv_id, turn)
    """
)
def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 with the hashing embedder; the answer stands for the truth."""
    a = _answers(spark, sf_dir)
    return a.select("conv_id", "turn", F.round(E.precision(F.col("answer"), F.col("ctx")), 6).alias("precision"))


# Each context's sentences against the answer, which stands for the truth.
_SENTENCE_PRECISION = f"""
    cs AS (SELECT conv_id, turn, i, answer AS whole, unnest({_EVAL_SENTS}) AS s FROM (SELECT conv_id, turn, unnest(ctx) AS answer, unnest(range(1, len(ctx) + 1)) AS i FROM a)),
    sn AS (SELECT conv_id, turn, i, row_number() OVER () AS k, s FROM cs),
    sk AS (SELECT conv_id, turn, i, k, unnest({tok("s")}) AS t FROM sn), sv AS (SELECT conv_id, turn, i, k, {_BIN} AS b, count(*) AS n FROM sk GROUP BY ALL), sl AS (SELECT k, sqrt(sum(n * n)) AS l FROM sv GROUP BY 1),
    rk AS (SELECT conv_id, turn, unnest({tok("answer")}) AS t FROM a), rv AS (SELECT conv_id, turn, {_BIN} AS b, count(*) AS n FROM rk GROUP BY ALL), rl AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS l FROM rv GROUP BY 1, 2),
    sd AS (SELECT sv.conv_id, sv.turn, i, k, sum(sv.n * rv.n) AS d FROM sv JOIN rv USING (conv_id, turn, b) GROUP BY ALL),
    hit AS (SELECT DISTINCT conv_id, turn, i FROM sd JOIN sl USING (k) JOIN rl USING (conv_id, turn) WHERE round(d / (sl.l * rl.l), 9) >= 0.35),
    sp AS (SELECT a.conv_id, a.turn, CASE WHEN len(ctx) = 0 THEN 0 ELSE coalesce(h, 0) / len(ctx) END::DOUBLE AS context_precision FROM a LEFT JOIN (SELECT conv_id, turn, count(*) AS h FROM hit GROUP BY 1, 2) USING (conv_id, turn))
"""


@query(f"WITH {_TALK}, {_SENTENCE_PRECISION} SELECT conv_id, turn, round(context_precision, 6) AS context_precision FROM sp")
def eval_sentence_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 with the hashing embedder."""
    a = _answers(spark, sf_dir)
    return a.select("conv_id", "turn", F.round(E.sentence_precision(F.col("answer"), F.col("ctx")), 6).alias("context_precision"))


_WIDE = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}'))"
#: The default embedder's bins of tokens, and the cosine of two texts' counts of them: pairs of equal bins are the dot product.
_BINS = "list_transform({}, lambda x: ('0x' || left(md5(x), 2))::INT % 64)"
_PAIRS_OF = "coalesce(list_sum(list_transform({a}, lambda i: len(list_filter({b}, lambda j: j = i)))), 0)"
_BIN_COSINE = "coalesce(" + _PAIRS_OF + " / nullif(sqrt(" + _PAIRS_OF.replace("{b}", "{a}") + ") * sqrt(" + _PAIRS_OF.replace("{a}", "{b}") + "), 0), 0)"

#: E1, E3, E5 and E6 of each answer that follows a question; the answer is its own truth, with a purpose added for E3.
_FOUR = rf"""
    {_TALK}, {_SENTENCE_PRECISION},
    x AS (SELECT conv_id, turn, answer, question, ctx, {_EVAL_SENTS} AS s, list_distinct(flatten(list_transform(ctx, lambda c: {_terms("c")}))) AS known,
        {_WIDE.format("answer")} AS wt, list_distinct(flatten(list_transform(ctx, lambda c: {_WIDE.format("c")}))) AS wc FROM a WHERE question IS NOT NULL),
    y AS (SELECT *, list_filter(s, lambda z: len({_terms("z")}) > 0 AND len(list_intersect({_terms("z")}, known)) / len({_terms("z")}) >= 0.5) AS ok FROM x),
    four AS (SELECT CASE WHEN trim(answer, {BLANKS}) = '' THEN 0.0 WHEN len(list_filter({strings(C.ABSTENTIONS)}, lambda p: contains(lower(answer), p))) > 0 THEN 1.0 WHEN len(s) = 0 THEN 0.0 ELSE len(ok) / len(s) END::DOUBLE AS faithfulness,
        ((len(list_intersect({_LONG.format("question")}, {_LONG.format("answer")})) > 0)::INT + (len(list_filter({strings(C.PURPOSES)}, lambda p: contains(lower(answer), p))) > 0)::INT
            + regexp_matches(regexp_replace(answer, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '(^| )\d+( |$)')::INT) / 3 AS answer_relevancy,
        context_precision, CASE WHEN answer = '' THEN 0 WHEN len(wt) <= {C.SHORT_TRUTH} THEN {_BIN_COSINE.format(a=_BINS.format(tok("answer")), b=_BINS.format(tok("array_to_string(ctx[1:3], ' ')")))}
            ELSE len(list_intersect(wt, wc)) / len(wt) END AS context_recall
        FROM y JOIN sp USING (conv_id, turn))
"""
_REPORT = ", ".join(f"round_even(avg({m}), 4) AS {m}" for m in E.FOUR)


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir).where("question is not null")
    return E.four_metrics(a.select("question", F.col("answer").alias("ground_truth"), "answer", F.col("ctx").alias("contexts")))


@query(f"WITH {_FOUR} SELECT {_REPORT}, count(*) AS n_samples FROM four")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8, A17."""
    return E.report(_four(spark, sf_dir), *E.FOUR)


@query(
    f"""
    WITH {_FOUR}, m AS (SELECT {_REPORT} FROM four), l AS (SELECT round(quantile_cont(value, 0.95), 6) AS p FROM events)
    SELECT 'faithfulness' AS gate, faithfulness AS value, 0.85::DOUBLE AS bar, coalesce(faithfulness >= 0.85, false) AS passed FROM m
    UNION ALL SELECT 'context_precision', context_precision, 0.5, coalesce(context_precision >= 0.5, false) FROM m
    UNION ALL SELECT 'retrieval_p95_ms', p, 1100, coalesce(p <= 1100, false) FROM l UNION ALL SELECT 'synthesis_p95_s', p / 100, 3, coalesce(p / 100 <= 3, false) FROM l
    """
)
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 on the report and on the events' values for latencies."""
    p95 = table(spark, sf_dir, "events").agg(*metrics.linear("value", 95))
    one = eval_report(spark, sf_dir).crossJoin(F.broadcast(p95))  # one row each
    return E.gates(one.withColumns({"retrieval_p95_ms": F.col("p95"), "synthesis_p95_s": F.col("p95") / 100}))


@query("SELECT count(*) AS n, round_even(avg(CASE WHEN coalesce(props, '') <> '' AND coalesce(event_type, '') <> '' THEN 1 ELSE 0 END), 4) AS coverage FROM events")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.provenance(table(spark, sf_dir, "events").select(F.col("props").alias("doc_id"), F.col("event_type").alias("domain")))


@query(
    rf"""
    WITH w AS (SELECT lang AS domain, trim(x, {BLANKS}) AS name, doc_id AS seen FROM (SELECT lang, doc_id, unnest({words("text")}) AS x FROM documents)),
    p AS (SELECT * FROM w WHERE name <> '' AND length(name) <= 80 AND len(list_filter({strings(C.RELATION_FRAGMENTS)}, lambda v: contains(lower(name), v))) = 0),
    c AS (SELECT domain, lower(name) AS key, count(*) AS occurrences, min(seen) AS first_seen, max(seen) AS last_seen FROM p GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY last_seen DESC, occurrences DESC, key) AS rank FROM c WHERE occurrences >= 3 QUALIFY rank <= 20
    """
)
def label_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dropped = docs.select(F.col("lang").alias("domain"), F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("name"), "doc_id", F.col("doc_id").alias("seen"))
    return labels.promote(labels.candidates(dropped)).drop("label").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*metrics.linear("value", 50, 95, 99))


@query("SELECT event_type, unnest([0.5, 0.95, 0.99])::DOUBLE AS p, count(*) AS n, true AS within FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 by sketches of each type and hour, merged by type: whether each quantile's exact rank is within the stated bound."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.date_trunc("hour", "ts").alias("hour"))
    kept = metrics.merged_sketches(metrics.sketches(e, ["event_type", "hour"], "value"), ["event_type"])
    asked = metrics.sketched_quantiles(kept, 0.5, 0.95, 0.99)
    ranks = e.where("value is not null").join(F.broadcast(asked), "event_type")  # three rows a type
    ranks = ranks.groupBy("event_type", "p", "n").agg(F.avg((F.col("value") < F.col("q")).cast("double")).alias("low"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("high"))
    error = metrics.sketch_error(C.SKETCH_SIZE)
    return ranks.select("event_type", "p", "n", ((F.col("low") - error <= F.col("p")) & (F.col("p") <= F.col("high") + error)).alias("within"))


@query(
    """
    WITH x AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    y AS (SELECT *, greatest(1, least(n - 1, floor((n + 1) * 19 / 20))) AS pos FROM x)
    SELECT event_type, round(sum(CASE WHEN i = pos THEN v * (1 - ((n + 1) * 19 / 20 - pos)) ELSE v * ((n + 1) * 19 / 20 - pos) END), 6) AS quantile FROM y WHERE i = pos OR i = pos + 1 GROUP BY 1
    """
)
def latency_quantile_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exclusive(table(spark, sf_dir, "events"), "event_type", "value")


@query(
    """
    WITH b(i, le, lo, hi) AS (VALUES (0, '0.1', -1e308, 0.1), (1, '0.25', 0.1, 0.25), (2, '0.5', 0.25, 0.5), (3, '1.0', 0.5, 1), (4, '2.0', 1, 2), (5, '3.0', 2, 3), (6, '5.0', 3, 5), (7, '10.0', 5, 10), (8, '+Inf', 10, 1e308)),
    n AS (SELECT i, le, count(value) AS n FROM b LEFT JOIN events ON value / 20 > lo AND value / 20 <= hi GROUP BY 1, 2)
    SELECT le, n, CAST(sum(n) OVER (ORDER BY i) AS BIGINT) AS cumulative FROM n
    """
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events").withColumn("s", F.col("value") / 20), "s")


@query("SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stages(table(spark, sf_dir, "events"), "event_type", "value")


@query(
    """
    WITH t AS (SELECT source, CAST(sum(1 - quality) AS BIGINT) AS dropped, count(*) AS entities FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, round_even(dropped * 100.0 / entities, 4)::DOUBLE AS pct FROM t)
    SELECT *, CASE WHEN pct >= 15 THEN 'high' WHEN pct <= 5 THEN 'low' ELSE 'medium' END AS verdict FROM p
    """
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.drift(d, "source", 1 - F.col("quality"), F.lit(1))


@query("SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: tumbling windows."""
    e = table(spark, sf_dir, "events")
    return streams.event_windows(e, "ts", ["event_type"], "1 hour").select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


@query(
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS s FROM events),
    h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM h GROUP BY user_id, k
    """
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: session windows."""
    e = streams.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")
    return e.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


@query(
    f"""
    WITH d AS (SELECT doc_id, CASE WHEN len({words("text")}) > 0 THEN array_to_string({words("text")}[1:12], ' ') ELSE '' END AS q, text FROM documents),
    k AS (SELECT doc_id AS id, unnest({tok("text")}) AS t FROM documents), f AS (SELECT id, {_BIN} AS b, count(*) AS n FROM k GROUP BY 1, 2), l AS (SELECT id, sqrt(sum(n * n)) AS l FROM f GROUP BY 1),
    qk AS (SELECT item_id AS qid, unnest({tok("text")}) AS t FROM benchmark), qf AS (SELECT qid, {_BIN} AS b, count(*) AS n FROM qk GROUP BY 1, 2), ql AS (SELECT qid, sqrt(sum(n * n)) AS l FROM qf GROUP BY 1),
    s AS (SELECT qid, id, round(sum(f.n * qf.n) / (any_value(l.l) * any_value(ql.l)), 6) AS score FROM qf JOIN f USING (b) JOIN l USING (id) JOIN ql USING (qid) GROUP BY 1, 2)
    SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5
    """
)
def hashed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with the hashing embedder: the nearest documents of each benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), hash_embed(F.col("text")).alias("vector"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), hash_embed(F.col("text")).alias("vector"))
    return top_k(q, docs, 5).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""
    WITH d AS (SELECT doc_id AS id, text FROM documents), q AS (SELECT doc_id AS qid, array_to_string({words("text")}[1:12], ' ') AS text FROM documents WHERE doc_id % 20 = 0),
    k AS (SELECT id, unnest({tok("text")}) AS t FROM d), f AS (SELECT id, {_BIN} AS b, count(*) AS n FROM k GROUP BY 1, 2), l AS (SELECT id, sqrt(sum(n * n)) AS l FROM f GROUP BY 1),
    qk AS (SELECT qid, unnest({tok("text")}) AS t FROM q), qf AS (SELECT qid, {_BIN} AS b, count(*) AS n FROM qk GROUP BY 1, 2), ql AS (SELECT qid, sqrt(sum(n * n)) AS l FROM qf GROUP BY 1),
    s AS (SELECT qid, id, round(sum(f.n * qf.n) / (any_value(l.l) * any_value(ql.l)), 6) AS score FROM qf JOIN f USING (b) JOIN l USING (id) JOIN ql USING (qid) GROUP BY 1, 2),
    h AS (SELECT qid, id FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5),
    w AS (SELECT qid, max((id = qid)::INT) AS hit FROM h GROUP BY 1)
    SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round_even(avg(hit), 4) AS recall FROM w
    """
)
def identity_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23 by the vectors of hashed_search: the first twelve words of every document whose id 20 divides (with a word)
    against all documents. A hashed vector of a few words finds its own document seldom; a trained one would more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), T.first_words(F.col("text"), 0, 12).alias("text"))
    q = first.where(F.size(T.tokens(F.col("text"))) > 0).select("qid", hash_embed(F.col("text")).alias("vector"))
    hits = top_k(q, docs.select(F.col("doc_id").alias("id"), hash_embed(F.col("text")).alias("vector")), 5)
    return E.identity_recall(hits.where("score > 0"))


@query("SELECT DISTINCT conv_id AS doc_id, 'Conv' || conv_id AS source_name, role AS target_name, 'SPOKE' AS relation_type, 1.0::DOUBLE AS confidence FROM conversations")
def relation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4 on answers made of conversation turns: a fenced list, a bare list and a cut-off one."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "role")
    one = F.concat(F.lit('{"source": "Conv'), F.col("doc_id").cast("string"), F.lit('.", "target": "'), "role", F.lit('", "type": "SPOKE"}'))
    shape = F.col("idx") % 3
    answer = F.when(shape == 0, F.concat(F.lit("```json\n["), one, F.lit("]\n```"))).when(shape == 1, F.concat(F.lit("So: ["), one, F.lit("]"))).otherwise(
        F.concat(F.lit('{"relations": ['), one, F.lit(', {"source": "x'))
    )
    names = c.select("doc_id", F.concat(F.lit("Conv"), F.col("doc_id").cast("string")).alias("name")).union(c.select("doc_id", "role")).distinct()
    kept, _ = X.relations(c.select("doc_id", "idx", answer.alias("answer")), names, ["SPOKE"])
    return kept


@query("SELECT event_id, props AS first, 1 AS n FROM events")
def salvaged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1, J-2 on every event's properties in broken wrappers."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("Result: "), "props", F.lit(' then {"source": "u'), F.col("user_id").cast("string"), F.lit('", "target": "'), "event_type", F.lit('"} and {"cut'))
    e = e.select("event_id", text.alias("t"))
    return e.select("event_id", P.json_object("t").alias("first"), F.size(P.salvaged("t")).alias("n"))


@query(
    r"""
    WITH x AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') THEN ['the|Word'] ELSE [] END || CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])que([^\p{L}\p{N}_]|$)') THEN ['que|Link'] ELSE [] END AS l FROM documents)
    SELECT doc_id, unnest(l) AS entity FROM x
    """
)
def gazetteer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 with the gazetteer recogniser."""
    found = X.entities(table(spark, sf_dir, "documents").select("doc_id", "text"), gazetteer({"the": "Word", "que": "Link"}))
    return found.select("doc_id", F.concat(F.lower("name"), F.lit("|"), "label").alias("entity"))


