"""Queries that retrieve: term statistics, terminology, vectors, aliases, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.functions.vectors import hash_embed
from quillspark.operators import aliases as A
from quillspark.operators import corrective as R
from quillspark.operators import dictionary, fusion, resolution, search, terminology, terms
from quillspark.plans.registry import BLANKS, query, sents, strings, table, tok, words

# A terminology of the documents: each is a concept, its sentences are its terms, its language that of the terms.
_CONCEPTS = f"""
    concepts AS (SELECT doc_id AS id, CASE WHEN source = 'src3' THEN 0 ELSE 1 END AS active FROM documents),
    descriptions AS (SELECT doc_id AS concept_id, unnest({sents("text")}) AS term, lang AS language_code, length(source) AS type_id FROM documents),
    tokens AS (SELECT DISTINCT concept_id AS id, unnest(regexp_extract_all(lower(term), '[a-z0-9]+')) AS token FROM descriptions JOIN concepts ON id = concept_id AND active = 1 WHERE language_code = 'en'),
    idf AS (SELECT token, count(DISTINCT id) AS df, ln((SELECT count(DISTINCT id) FROM concepts WHERE active = 1) / count(DISTINCT id)) AS idf FROM tokens GROUP BY 1),
    cedges AS (SELECT l_orderkey % 1000 AS src, l_partkey % 1000 AS dst, CASE l_linestatus WHEN 'O' THEN 'REL_246090004' ELSE 'REL_116680003' END AS rel FROM lineitem WHERE l_returnflag <> 'N'
        UNION ALL SELECT l_orderkey % 1000, l_partkey % 1000, 'OTHER' FROM lineitem WHERE l_returnflag = 'N')
"""


def _terminology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    concepts = docs.select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src3", 0).otherwise(1).alias("active"))
    descriptions = docs.select(
        F.col("doc_id").alias("concept_id"), F.explode(T.sentences(F.col("text"))).alias("term"), F.col("lang").alias("language_code"), F.length("source").alias("type_id")
    )
    rel = F.when(F.col("l_returnflag") == "N", "OTHER").when(F.col("l_linestatus") == "O", "REL_246090004").otherwise("REL_116680003")
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("src"), (F.col("l_partkey") % 1000).alias("dst"), rel.alias("rel"))
    return concepts, descriptions, edges


#: Questions of literal words that the documents have.
_ASKED = [(1, "the, thereou; and that"), (2, "tionble and inther, erand"), (3, "with; from and this"), (4, "nothing at all")]
_ASKED_SQL = "asked(qid, text) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in _ASKED) + ")"
_KEYWORDS = rf"keys AS (SELECT DISTINCT qid, k AS keyword FROM (SELECT qid, trim(unnest(string_split_regex(lower(text), '\band\b|,|;')), {BLANKS}) AS k FROM asked) WHERE length(k) > 2)"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ASKED, "qid int, text string")


@query(f"WITH {_CONCEPTS} SELECT token, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts, descriptions, _ = _terminology(spark, sf_dir)
    return terminology.idf_table(concepts, descriptions).withColumn("idf", F.round("idf", 9))


_MATCHED = f"""
    hit AS (SELECT k.keyword, id, row_number() OVER (PARTITION BY k.keyword ORDER BY id) AS n FROM (SELECT DISTINCT keyword FROM keys) k JOIN tokens ON token = keyword QUALIFY n <= {C.CONCEPTS_PER_KEYWORD}),
    matched AS (SELECT qid, keyword, idf, id FROM keys JOIN idf ON token = keyword AND idf > 0 JOIN hit USING (keyword)),
    scored AS (SELECT qid, id, sum(idf) AS score, count(*) AS n_terms FROM matched GROUP BY 1, 2)
"""


@query(
    f"""
    WITH {_ASKED_SQL}, {_CONCEPTS}, {_KEYWORDS}, {_MATCHED}
    SELECT qid, id, round(score, 6) AS score, n_terms, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, id) AS rank FROM scored QUALIFY rank <= 20
    """
)
def term_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators.ranking import top_per

    concepts, descriptions, _ = _terminology(spark, sf_dir)
    asked = _asked(spark).select("qid", F.explode(F.array_distinct(T.keywords(F.col("text")))).alias("keyword"))
    matched = terms.capped_postings(terminology.all_active_tokens(concepts, descriptions), terminology.n_active(concepts), asked)
    scored = terms.term_scores(matched).select("qid", "id", F.round("score", 6).alias("score"), "n_terms")
    return top_per(scored, ["qid"], [F.col("score").desc(), F.col("id")], 20).withColumn("rank", F.col("rank").cast("long"))


_NAMES = "names AS (SELECT concept_id AS id, term AS name FROM descriptions QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY language_code <> 'en', type_id DESC, term) = 1)"


@query(
    f"""
    WITH {_ASKED_SQL}, {_CONCEPTS}, {_KEYWORDS}, {_MATCHED}, {_NAMES},
    e AS (SELECT DISTINCT src, dst FROM cedges WHERE rel IN {tuple(C.EXPANSION_RELATIONS)}),
    grown AS (SELECT qid, id, sum(c) AS edges FROM (SELECT qid, dst AS id, count(DISTINCT s.id) AS c FROM scored s JOIN e ON s.id = src GROUP BY 1, 2
        UNION ALL SELECT qid, src, count(DISTINCT s.id) FROM scored s JOIN e ON s.id = dst GROUP BY 1, 2) GROUP BY 1, 2),
    full_ AS (SELECT qid, id, round(coalesce(score, 0) + 2 * coalesce(edges, 0), 6) AS score, coalesce(n_terms, 0) AS n_terms, CAST(coalesce(edges, 0) AS BIGINT) AS edges FROM scored FULL JOIN grown USING (qid, id))
    SELECT qid, f.id, score, n_terms, edges, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f.id) AS rank, coalesce(name, CAST(f.id AS VARCHAR)) AS name
    FROM full_ f LEFT JOIN names USING (id) QUALIFY rank <= 5
    """
)
def symptom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3."""
    out = terminology.by_symptoms(_asked(spark), *_terminology(spark, sf_dir))
    return out.select("qid", "id", "score", "n_terms", "edges", F.col("rank").cast("long").alias("rank"), "name")


_DAYS = [
    (1, '{"day1": ["the", "thereou"], "day10": ["that"], "day2": ["with", "from", "of"]}'),
    (2, '{"d3": ["tionble"], "d1": ["erand", "and"]}'),
    (3, "no presentation"),
]
_DAYS_SQL = """
    days(qid, nth, keyword) AS (VALUES (1, 1, 'the'), (1, 1, 'thereou'), (1, 3, 'that'), (1, 2, 'with'), (1, 2, 'from'), (2, 2, 'tionble'), (2, 1, 'erand'), (2, 1, 'and')),
    keys AS (SELECT DISTINCT qid, keyword FROM days)
"""


@query(
    f"""
    WITH {_CONCEPTS}, {_DAYS_SQL}, {_MATCHED}, {_NAMES},
    t AS (SELECT qid, id, sum(idf * [1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE][nth]) AS score, count(*) AS n_terms FROM matched JOIN days USING (qid, keyword) GROUP BY 1, 2),
    txt AS (SELECT concept_id AS id, string_agg(DISTINCT lower(term), ' ' ORDER BY lower(term)) AS a FROM descriptions WHERE language_code = 'en' GROUP BY 1),
    cov AS (SELECT t.qid, t.id, count(DISTINCT nth) AS days FROM t JOIN txt USING (id) JOIN days d ON d.qid = t.qid AND contains(a, d.keyword) GROUP BY 1, 2),
    f AS (SELECT qid, id, round(CASE WHEN coalesce(days, 0) > 1 THEN score * pow(days, 1.5) ELSE score END, 6) AS score, n_terms, coalesce(days, 0) AS days FROM t LEFT JOIN cov USING (qid, id))
    SELECT qid, f.id, score, n_terms, days, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f.id) AS rank, coalesce(name, CAST(f.id AS VARCHAR)) AS name
    FROM f LEFT JOIN names USING (id) QUALIFY rank <= 5
    """
)
def temporal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4."""
    concepts, descriptions, _ = _terminology(spark, sf_dir)
    asked = spark.createDataFrame(_DAYS, "qid int, text string")
    out = terminology.by_presentation(asked, concepts, descriptions)
    return out.select("qid", "id", "score", "n_terms", "days", F.col("rank").cast("long").alias("rank"), "name")


@query(
    """
    WITH c AS (SELECT DISTINCT user_id AS id, event_type AS token, CAST(ts AS DATE) AS d FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM events),
    idf AS (SELECT token, ln(n / count(DISTINCT id)) AS idf FROM c, n GROUP BY token, n), dd AS (SELECT d, dense_rank() OVER (ORDER BY d) AS nth FROM (SELECT DISTINCT d FROM c)),
    s AS (SELECT id, sum(idf * [1.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE, 2.5::DOUBLE, 3.0::DOUBLE][least(nth, 5)]) AS score, count(DISTINCT d) AS days FROM c JOIN idf USING (token) JOIN dd USING (d) GROUP BY 1)
    SELECT id, round(CASE WHEN days > 1 THEN score * pow(days, 1.5) ELSE score END, 6) AS score, days FROM s
    """
)
def temporal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 on events: users are concepts, event types keywords, dates days."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("id"), F.col("event_type").alias("token"), F.to_date("ts").alias("d")).distinct()
    idf = terms.idf(c, e.select("user_id").distinct().count())
    days = c.select("d").distinct().withColumn("nth", F.dense_rank().over(W.orderBy("d")))
    s = c.join(idf, "token").join(days, "d").groupBy("id").agg(
        F.sum(F.col("idf") * terms.day_weight(F.col("nth"))).alias("score"), F.countDistinct("d").alias("days")
    )
    return s.select("id", F.round(terms.day_boost(F.col("score"), F.col("days")), 6).alias("score"), "days")


@query(f"WITH {_CONCEPTS}, {_NAMES} SELECT id, name FROM names")
def preferred_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminology.preferred_names(_terminology(spark, sf_dir)[1])


@query(
    f"""
    WITH {_CONCEPTS}, t AS (SELECT DISTINCT array_to_string({words("text")}[1:2], ' ') AS title FROM documents)
    SELECT title, min(concept_id) AS concept_id FROM t JOIN descriptions ON language_code = 'en' AND contains(lower(term), lower(title)) WHERE title <> '' GROUP BY 1
    """
)
def title_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "documents").select(T.first_words(F.col("text"), 0, 2).alias("title"))
    return terminology.concept_of_title(titles, _terminology(spark, sf_dir)[1])


@query(
    f"""
    WITH {_CONCEPTS}, c AS (SELECT DISTINCT array_to_string({words("text")}[4:5], ' ') AS candidate FROM documents)
    SELECT DISTINCT candidate, concept_id, term FROM c JOIN descriptions ON contains(term, candidate) WHERE candidate <> ''
    """
)
def candidate_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, with the fourth and fifth word of each document for a candidate."""
    names = table(spark, sf_dir, "documents").select(T.first_words(F.col("text"), 3, 5).alias("candidate"))
    return terminology.descriptions_of(names, _terminology(spark, sf_dir)[1])


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The searches' query set, every vector whose id 20 divides, and all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v.where("id % 20 = 0").withColumnRenamed("id", "qid"), v


_SCORES = "s AS (SELECT a.vec_id AS qid, a.label AS ql, b.vec_id AS id, b.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


def _vector_topk(q: DataFrame, v: DataFrame) -> DataFrame:
    return search.top_k(q, v, 10).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SCORES} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_topk(*_vectors(spark, sf_dir))


def _vector_topk_multi(q: DataFrame, v: DataFrame) -> DataFrame:
    merged = search.merge_collections(search.top_k(q, v, 5, ["label"]), 12)
    return merged.select("qid", "id", "label", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""
    WITH {_SCORES}, p AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS n FROM s QUALIFY n <= 5)
    SELECT qid, id, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= 12
    """
)
def vector_topk_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_topk_multi(*_vectors(spark, sf_dir))


def _semantic_cache(q: DataFrame, v: DataFrame) -> DataFrame:
    q, v = (d.withColumn("scope", F.col("label").cast("string")) for d in (q, v))
    hits = search.top_k(q.select("qid", "vector"), v, 2, ["scope"], 0.2)
    own = hits.join(q.select("qid", "scope"), ["qid", "scope"]).where("qid <> id")
    from quillspark.operators.ranking import first_per

    return first_per(own, ["qid"], [F.col("score").desc(), F.col("id")]).select("qid", "scope", "id", "score")


@query(f"WITH {_SCORES} SELECT qid, CAST(label AS VARCHAR) AS scope, id, score FROM s WHERE label = ql AND score >= 0.2 AND id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1")
def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12 with a floor that the test vectors reach: of the two best of its scope the one that isn't the query itself."""
    return _semantic_cache(*_vectors(spark, sf_dir))


def _entity_resolution(q: DataFrame, v: DataFrame) -> DataFrame:
    hits = search.top_k(q, v, 1, ["label"], 0.35).join(q.select("qid", F.col("label").alias("ql")), "qid").where("label <> ql")
    from quillspark.operators.ranking import first_per

    best = first_per(hits, ["qid"], [F.col("score").desc(), F.col("id")]).select("qid", "id")
    return q.select("qid").join(best, "qid", "left").select(
        F.col("qid").alias("name"), F.col("id").isNotNull().alias("matched"), F.col("id").cast("string").alias("match")
    )


@query(
    f"""
    WITH {_SCORES}, b AS (SELECT qid, id AS match FROM s WHERE label <> ql AND score >= 0.35 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) = 1)
    SELECT vec_id AS name, b.match IS NOT NULL AS matched, CAST(match AS VARCHAR) AS match FROM (FROM embeddings WHERE vec_id % 20 = 0) LEFT JOIN b ON qid = vec_id
    """
)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asked vector against the existing nodes of other labels, at a threshold that some reach."""
    return _entity_resolution(*_vectors(spark, sf_dir))


_ALIASES = [("Then Of", "Thenable", ["thonor", "the"], 1), ("La Mentoi", "Place", ["que", "la"], 2), ("Einung", "Org", ["der", "die das"], 3), ("The", "Word", [], 4)]
_AMAP = "amap(alias, canonical) AS (VALUES ('thonor', 'Then Of'), ('the', 'Then Of'), ('que', 'La Mentoi'), ('la', 'La Mentoi'), ('der', 'Einung'), ('die das', 'Einung'), ('then of', 'Then Of'), ('la mentoi', 'La Mentoi'), ('einung', 'Einung'))"


def _alias_table(spark: SparkSession) -> DataFrame:
    return A.alias_map(spark.createDataFrame(_ALIASES, "name string, type string, aliases array<string>, ord int"))


@query(
    """
    WITH e AS (SELECT p_partkey AS ord, p_name AS name, p_type AS type, list_concat(string_split(p_name, ' '), [p_brand || ' ' || p_size]) AS aliases FROM part),
    k AS (SELECT lower(unnest(aliases)) AS alias, name, 1 AS p, ord FROM e UNION ALL SELECT lower(name), name, 0, -ord FROM e WHERE coalesce(type, '') <> '')
    SELECT alias, max_by(name, {'p': p, 'ord': ord, 'name': name}) AS canonical FROM k WHERE alias <> '' GROUP BY 1
    """
)
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part goes by the words of its name and by its brand and size; of several parts of an alias the last wins."""
    part = table(spark, sf_dir, "part")
    also = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    return A.alias_map(part.select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.concat(F.split("p_name", " "), F.array(also)).alias("aliases"), F.col("p_partkey").alias("ord")))


@query(
    rf"""
    WITH {_AMAP}, h AS (SELECT doc_id AS qid, canonical, max(length(alias)) AS n, min((-length(alias), alias)) AS k FROM documents JOIN amap ON lower(canonical) <> alias
        AND regexp_matches(' ' || lower(text) || ' ', '[^\p{{L}}\p{{N}}_]' || alias || '[^\p{{L}}\p{{N}}_]') GROUP BY 1, 2),
    a AS (SELECT qid, string_agg(canonical, '; ' ORDER BY k) AS x FROM h GROUP BY 1)
    SELECT doc_id AS qid, CASE WHEN x IS NULL THEN text ELSE text || ' (' || x || ')' END AS expanded FROM documents LEFT JOIN a ON qid = doc_id
    """
)
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text")
    return A.expand_queries(q, _alias_table(spark)).select("qid", "expanded")


# Fusion: a query is a nation; two signals rank its customers and its suppliers, by balance.
_POOL = """
    p AS (
        SELECT c_nationkey AS qid, 'graph' AS signal, '[DIAGNOSIS CANDIDATE] ' || c_mktsegment || ' (SNOMED ' || c_custkey || ')' AS text, 'c' || c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'graph_edge' ELSE 'chunk' END AS doc_type,
            CAST(c_custkey % 40 AS VARCHAR) AS concept_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, 0 AS o FROM customer QUALIFY r <= 8
        UNION ALL
        SELECT s_nationkey, 'prose', '[CLINICAL PROSE] ' || CASE WHEN s_suppkey % 4 = 0 THEN 'Build' ELSE 'x' || s_suppkey END || chr(10) || s_name, 's' || s_suppkey, 'chunk', CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 40 AS VARCHAR) END,
            row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r, 1 AS o FROM supplier QUALIFY r <= 8
    ), a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o, r, doc_id, text) AS arrival FROM p),
    n AS (SELECT *, lower(trim(string_split(string_split(trim(replace(replace(text, '[DIAGNOSIS CANDIDATE]', ''), '[CLINICAL PROSE]', '')), chr(10))[1], '(SNOMED')[1])) AS name FROM a),
    d AS (SELECT x.*, x.name <> '' AND EXISTS (SELECT 1 FROM n y WHERE y.qid = x.qid AND y.signal <> x.signal AND (y.concept_id = x.concept_id OR y.name <> '' AND (contains(y.name, x.name) OR contains(x.name, y.name)))) AS dual FROM n x)
"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators.ranking import top_per

    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    graph = top_per(c, ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 8, "arrival").select(
        F.col("c_nationkey").alias("qid"), F.lit("graph").alias("signal"), "arrival",
        F.concat(F.lit("[DIAGNOSIS CANDIDATE] "), "c_mktsegment", F.lit(" (SNOMED "), F.col("c_custkey").cast("string"), F.lit(")")).alias("text"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("doc_id"), F.when(F.col("c_custkey") % 3 == 0, "graph_edge").otherwise("chunk").alias("doc_type"),
        (F.col("c_custkey") % 40).cast("string").alias("concept_id"),
    )
    title = F.when(F.col("s_suppkey") % 4 == 0, "Build").otherwise(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")))
    prose = top_per(s, ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 8, "arrival").select(
        F.col("s_nationkey").alias("qid"), F.lit("prose").alias("signal"), "arrival",
        F.concat(F.lit("[CLINICAL PROSE] "), title, F.lit("\n"), "s_name").alias("text"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc_id"), F.lit("chunk").alias("doc_type"),
        F.when(F.col("s_suppkey") % 2 == 0, (F.col("s_suppkey") % 40).cast("string")).alias("concept_id"),
    )
    return fusion.dual_flags(fusion.dedupe(fusion.union_signals(graph, prose)))


@query(f"WITH {_POOL} SELECT qid, signal, doc_id, arrival, dual FROM d")
def fusion_dual_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("qid", "signal", "doc_id", F.col("arrival").cast("long").alias("arrival"), "dual")


_RANKED = """
    r AS (SELECT qid, doc_id, dual, round(CASE WHEN signal = 'graph' THEN 0.4 ELSE 0.1 END + CASE WHEN dual THEN 0.15 ELSE 0 END + CASE WHEN doc_type = 'graph_edge' THEN 0.001 ELSE 0 END, 6)::DOUBLE AS score, arrival,
        CASE WHEN signal = 'graph' THEN 'medium' ELSE 'low' END AS confidence FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, arrival) AS rank FROM r QUALIFY rank <= 6)
"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.ranked(_pool(spark, sf_dir), 6, F.when(F.col("signal") == "graph", 0.4).otherwise(0.1))


@query(f"WITH {_POOL}, {_RANKED} SELECT qid, doc_id, dual, score, rank, confidence FROM k")
def fusion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("qid", "doc_id", "dual", "score", F.col("rank").cast("long").alias("rank"), "confidence")


@query(f"WITH {_POOL}, {_RANKED}, f AS (SELECT *, max(CASE WHEN confidence <> 'low' THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS a FROM k) SELECT qid, doc_id, confidence, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM f WHERE confidence <> 'low' OR a = 0")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.floor(_ranked(spark, sf_dir), "medium").select("qid", "doc_id", "confidence", F.col("rank").cast("long").alias("rank"))


@query(
    """
    WITH r AS (SELECT c_nationkey AS qid, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
    b AS (SELECT qid, CASE WHEN doc_id = '' THEN '__graph__' ELSE doc_id END AS source, min(rank) AS rank FROM r GROUP BY 1, 2)
    SELECT qid, source, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS ref FROM b
    """
)
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    r = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("qid"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("doc_id"), F.row_number().over(w).cast("long").alias("rank")
    )
    return fusion.bibliography(r).select("qid", "source", "rank", F.col("ref").cast("long").alias("ref"))


_ROUTES = [
    (1, "who reported BUG-204?"), (2, "why did the checkout service fail?"), (3, "when was it released"), (4, "What is the design of this?"),
    (5, "which one of the many services that we run every day is down"), (6, "compare PR-1 and PR-2"), (7, "summarise the report"),
]
_ROUTES_SQL = "r(qid, text) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in _ROUTES) + ")"
_QUERIES_SQL = f"{_ROUTES_SQL}, q AS (SELECT qid::BIGINT AS qid, text FROM r UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations WHERE role = 'user')"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return spark.createDataFrame(_ROUTES, "qid long, text string").union(c.select(F.lit(1000) + F.col("conv_id") * 100 + F.col("turn"), "text"))


@query(
    rf"""
    WITH {_QUERIES_SQL}
    SELECT qid, CASE WHEN regexp_matches(text, '\b[A-Za-z]{{2,}}-\d+\b') OR (regexp_matches(text, '(?i)^\s*(who|what|when|where|which)\b')
        AND NOT regexp_matches(text, '(?i)\b(why|how|compare|analyz|impact|cause|explain|trade-?off|design|recommend)\w*\b') AND len({words("text")}) <= 8) THEN 'graph' ELSE 'hybrid' END AS path FROM q
    """
)
def crag_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select("qid", T.route(F.col("text")).alias("path"))


_STOP = strings(C.QUESTION_STOPWORDS)


@query(f"WITH {_QUERIES_SQL}, t AS (SELECT qid, text, list_filter({tok('text')}, lambda x: NOT list_contains({_STOP}, x)) AS k FROM q) SELECT qid, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE text END AS rewritten FROM t")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select("qid", T.rewrite(F.col("text")).alias("rewritten"))


@query(
    f"""
    WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ctx FROM conversations),
    t AS (SELECT conv_id, turn, ctx, list_filter(list_distinct({tok("text")}), lambda x: NOT list_contains({_STOP}, x)) AS q, {tok("ctx")} AS k FROM c),
    s AS (SELECT *, len(list_filter(q, lambda x: list_contains(k, x))) / len(q) AS share FROM t)
    SELECT conv_id, turn, CASE WHEN ctx IS NULL THEN 'INCORRECT' WHEN len(q) = 0 OR share >= 0.5 THEN 'CORRECT' WHEN share >= 0.2 THEN 'AMBIGUOUS' ELSE 'INCORRECT' END AS grade FROM s
    """
)
def crag_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a question, the next one of its conversation as its context."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations")
    nxt = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    c = c.select("conv_id", "turn", "text", nxt.alias("ctx"))
    contexts = F.when(F.col("ctx").isNull(), F.array().cast("array<string>")).otherwise(F.array("ctx"))
    return c.select("conv_id", "turn", R.grade(F.col("text"), contexts).alias("grade"))


@query(
    """
    WITH c AS (SELECT c_nationkey AS qid, c_mktsegment AS text, c_acctbal AS raw, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS arrival FROM customer),
    o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid, text ORDER BY arrival) = 1), p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY qid ORDER BY arrival) <= 15)
    SELECT qid, text, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 6) DESC, arrival) AS rank FROM p QUALIFY rank <= 5
    """
)
def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("qid"), F.lit("d").alias("doc_id"), F.col("c_mktsegment").alias("text"), "c_acctbal",
        F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("arrival"),
    )
    return R.condense(c, F.col("c_acctbal")).select("qid", "text", "score", F.col("rank").cast("long").alias("rank"))


def _weighted(asked: DataFrame) -> DataFrame:
    """(qid, terms) of questions (qid, text): their hashed tokens with their counts."""
    found = terms.sparse_vectors(asked, ["qid"], "text")
    return found.groupBy("qid").agg(F.collect_list(F.struct(F.col("idx").alias("token"), F.col("tf").alias("weight"))).alias("terms"))


def _sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    pieces = docs.select("doc_id", "lang", F.posexplode(T.sentences(F.col("text"))).alias("chunk_idx", "text"))
    bins = F.transform(T.tokens(F.col("text")), T.sparse_bin)
    said = pieces.select(F.coalesce("lang", F.lit("")).alias("coll"), "doc_id", "chunk_idx", bins.alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text").dropDuplicates(["qid"])
    hits = search.posting_top_k(_weighted(asked), said, ["doc_id", "chunk_idx"], 5, ["coll"]).withColumn("id", F.struct("doc_id", "chunk_idx"))
    return search.merge_collections(hits, 10).select(
        "qid", "coll", F.col("id.doc_id").alias("doc_id"), F.col("id.chunk_idx").cast("long").alias("chunk_idx"), "score", F.col("rank").cast("long").alias("rank")
    )


@query(
    rf"""
    WITH c AS (SELECT doc_id, coalesce(lang, '') AS coll, unnest({sents('text')}) AS text, unnest(range(len({sents('text')}))) AS chunk_idx FROM documents),
    ct AS (SELECT coll, doc_id, chunk_idx, ('0x' || substr(md5(x), 3, 2) || substr(md5(x), 1, 2))::BIGINT AS idx, count(*) AS tf
        FROM (SELECT coll, doc_id, chunk_idx, unnest({tok('text')}) AS x FROM c) GROUP BY ALL),
    qt AS (SELECT qid, ('0x' || substr(md5(x), 3, 2) || substr(md5(x), 1, 2))::BIGINT AS idx, count(*) AS tf
        FROM (SELECT item_id AS qid, unnest({tok('text')}) AS x FROM benchmark) GROUP BY ALL),
    s AS (SELECT qid, coll, doc_id, chunk_idx, sum(qt.tf * ct.tf)::DOUBLE AS score FROM qt JOIN ct USING (idx) GROUP BY ALL),
    p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, coll ORDER BY score DESC, doc_id, chunk_idx) <= 5)
    SELECT qid, coll, doc_id, chunk_idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_idx) AS rank FROM p QUALIFY rank <= 10
    """
)
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, L1: each benchmark item's hashed token counts against all sentences of all documents, a collection a language."""
    return _sparse_topk(spark, sf_dir)


@query(
    """
    WITH d AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS e, b.embedding::DOUBLE[] AS f FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    w AS (SELECT *, unnest([0, 1, 2]) AS m FROM d),
    v AS (SELECT vec_id % 20 = 0 AND m = 0 AS known, vec_id * 3 + (vec_id + m) % 3 AS vec_id, 'v' || vec_id || '.' || m AS name,
        CASE WHEN f IS NULL THEN e ELSE list_transform(list_zip(e, f), lambda x: x[1] + CASE m WHEN 0 THEN 0.0 WHEN 1 THEN 0.3 ELSE 0.4 END::DOUBLE * x[2]) END AS e FROM w),
    n AS (FROM v WHERE NOT known),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.known AS old, a.name AS node, round(list_cosine_similarity(a.e, b.e), 9) AS score
        FROM v a JOIN n b ON a.known OR a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.88),
    x AS (SELECT n.vec_id, coalesce(list(a) FILTER (WHERE NOT old), []) AS earlier FROM n LEFT JOIN s ON b = n.vec_id GROUP BY 1 HAVING NOT coalesce(bool_or(old), false)),
    l AS (SELECT list_reduce(list_concat([{'l': []::BIGINT[], 'e': []::BIGINT[]}], list({'l': [vec_id], 'e': earlier} ORDER BY vec_id)),
        lambda acc, y: CASE WHEN list_has_any(acc.l, y.e) THEN acc ELSE {'l': list_concat(acc.l, y.l), 'e': []::BIGINT[]} END).l AS leaders FROM x),
    c AS (SELECT b, node, score FROM s, l WHERE old OR list_contains(leaders, a) QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, NOT old, CASE WHEN old THEN node END, a) = 1)
    SELECT name, c.node IS NOT NULL AS matched, coalesce(c.node, name) AS node, round(score, 6) AS score FROM n LEFT JOIN c ON b = vec_id
    """
)
def entity_resolution_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 in a batch: each vector is mentioned as it is and twice with some of the vector of the next id, in mixed order.
    Those that are as they are and whose id 20 divides are nodes, all others names that are resolved one after another."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    said = v.join(after, "vec_id", "left").withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    some = F.element_at(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.4)), F.col("m") + 1)
    said = said.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit("."), F.col("m").cast("string")).alias("name"), F.lit("").alias("type"),
        F.when(F.col("f").isNull(), F.col("e")).otherwise(F.zip_with("e", "f", lambda x, y: x + some * y)).alias("vector"),
        (F.col("vec_id") * 3 + (F.col("vec_id") + F.col("m")) % 3).alias("ord"), ((F.col("vec_id") % 20 == 0) & (F.col("m") == 0)).alias("known"),
    )
    found = resolution.resolve_batch(said.where("not known").drop("known"), said.where("known").select(F.col("name").alias("id"), "vector"))
    made = found.where("not matched").select("id", F.col("name").alias("own"))
    return found.join(made, "id", "left").select("name", "matched", F.coalesce("own", "id").alias("node"), F.round("score", 6).alias("score"))


@query(
    rf"""
    WITH n AS (SELECT DISTINCT t AS name FROM (SELECT unnest({tok('text')}) AS t FROM benchmark) WHERE length(t) >= 3),
    d AS (SELECT doc_id, unnest({tok('text')}) AS name FROM documents)
    SELECT doc_id, name, CASE WHEN length(name) > 7 THEN 'long' ELSE 'short' END AS label, count(*) AS n FROM d JOIN n USING (name) GROUP BY ALL
    """
)
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark as a dictionary, found in all documents in one pass a text."""
    word = F.explode(T.tokens(F.col("text"))).alias("name")
    names = table(spark, sf_dir, "benchmark").select(word).distinct().where("length(name) >= 3").withColumn("label", F.when(F.length("name") > 7, "long").otherwise("short"))
    found = dictionary.dictionary_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), names)
    return found.groupBy("doc_id", F.lower("name").alias("name"), "label").agg(F.count("*").alias("n"))


@query(
    rf"""
    WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, role, {tok('text')} AS t FROM conversations),
    x AS (SELECT id, md5(unnest(t)) AS m FROM c), b AS (SELECT id, ('0x' || left(m, 2))::INT % 64 AS bin, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
    f AS (SELECT id, ('0x' || substr(m, 3, 2) || left(m, 2))::INT AS bin, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
    l AS (SELECT id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1), q AS (SELECT id FROM c WHERE role = 'user' AND conv_id % 20 = 0), a AS (SELECT id FROM c WHERE role = 'assistant'),
    d AS (SELECT u.id AS qid, w.id, round(sum(u.n * w.n) / any_value(lu.norm) / any_value(lw.norm), 6) AS score FROM b u JOIN b w USING (bin) JOIN l lu ON lu.id = u.id JOIN l lw ON lw.id = w.id
        WHERE u.id IN (FROM q) AND w.id IN (FROM a) GROUP BY ALL),
    p AS (SELECT u.id AS qid, w.id, sum(u.n * w.n) AS score FROM f u JOIN f w USING (bin) WHERE u.id IN (FROM q) AND w.id IN (FROM a) GROUP BY ALL),
    s AS (SELECT *, score / greatest(max(score) OVER (PARTITION BY qid), 1e-12) * 0.5 AS s FROM (FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20)
        UNION ALL SELECT *, score / greatest(max(score) OVER (PARTITION BY qid), 1e-12) * 0.5 AS s FROM (FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 20)),
    h AS (SELECT qid, id, round(sum(s), 6) AS score FROM s GROUP BY ALL)
    SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 5
    """
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse search, fused: what users say in conversations whose id 20 divides, against all assistants' turns."""
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "role", "text")
    asked, told = said.where("role = 'user' and conv_id % 20 = 0"), said.where("role = 'assistant'")
    vector = lambda d, name: d.select(F.col("id").alias(name), hash_embed(F.col("text")).alias("vector"))
    dense = search.top_k(vector(asked, "qid"), vector(told, "id"), 20).where("score > 0")
    bins = told.select("id", F.transform(T.tokens(F.col("text")), T.sparse_bin).alias("tokens"))
    sparse = search.posting_top_k(_weighted(asked.select(F.col("id").alias("qid"), "text")), bins, ["id"], 20)
    return search.hybrid_scores(dense, sparse, 5).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))
