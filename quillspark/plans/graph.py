"""Queries over graphs: entities of orders, neighbourhoods, centrality, transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.operators import documents as D
from quillspark.operators import extraction as X
from quillspark.operators import graph as G
from quillspark.operators import transactions as TX
from quillspark.plans.registry import query, table

# Nodes: suppliers (S...), named by part they come with; edges: supplier to part; a document is an order.
_MENTIONS = "m AS (SELECT 'S' || l_suppkey AS id, 'Supplier ' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN ' Ltd' ELSE '' END AS name, l_returnflag AS type, l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"
_EDGES = "e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_returnflag || '-' || l_linestatus AS type, l_orderkey AS doc_id FROM lineitem)"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " Ltd").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("id"), name.alias("name"), F.col("l_returnflag").alias("type"),
        F.col("l_orderkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"),
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("type"), F.col("l_orderkey").alias("doc_id"),
    )


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(
    f"""
    WITH {_MENTIONS}
    SELECT id, arg_min(name, (ord, name)) AS name, arg_min(type, (ord, type)) AS type, array_to_string(list_sort(list(DISTINCT name)), ',') AS aliases,
        array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS source_docs FROM m GROUP BY 1
    """
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir)
    n = G.merge_nodes(m.withColumn("ord", F.struct("ord", "name", "type")))
    return n.select("id", "name", "type", F.array_join("aliases", ",").alias("aliases"), _joined("source_docs").alias("source_docs"))


@query(
    rf"""
    WITH {_EDGES}
    SELECT src, dst, upper(replace(type, '-', '_')) AS rel, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS source_docs FROM e GROUP BY 1, 2, 3
    """
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_edges(_edges(spark, sf_dir)).select("src", "dst", "rel", _joined("source_docs").alias("source_docs"))


@query(
    r"""
    WITH r AS (SELECT n_name AS name, 'N' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT r_name, 'R' || r_regionkey FROM region)
    SELECT s.id AS src, d.id AS dst, upper(replace(c_mktsegment, ' ', '_')) AS rel, c_custkey AS doc_id
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN r s ON s.name = n_name JOIN r d ON d.name = r_name
    """
)
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the names of customers' nations and regions; a fifth of the nations have no node."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    key = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string")).alias("id")
    resolver = n.where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("name"), key("N", "n_nationkey")).union(r.select("r_name", key("R", "r_regionkey")))
    named = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    rel = F.upper(F.replace("c_mktsegment", F.lit(" "), F.lit("_"))).alias("rel")
    edges = named.select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), rel, F.col("c_custkey").alias("doc_id"))
    return G.resolve_edges(edges, resolver).select("src", "dst", "rel", "doc_id")


_DELETED = f"""
    {_MENTIONS}, {_EDGES}, x AS (SELECT max(l_orderkey) AS k FROM lineitem),
    n AS (SELECT id, list(DISTINCT doc_id) AS d FROM m, x WHERE doc_id <> k GROUP BY 1),
    g AS (SELECT src, dst, upper(replace(type, '-', '_')) AS rel, count(DISTINCT doc_id) AS n_docs FROM e, x WHERE doc_id <> k GROUP BY 1, 2, 3)
"""


def _deleted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    parts = _edges(spark, sf_dir)
    nodes = G.merge_nodes(_mentions(spark, sf_dir))
    ids = parts.select(F.col("dst").alias("id"), F.col("dst").alias("name"), F.lit("part").alias("type"), "doc_id", F.col("doc_id").alias("ord"))
    return G.delete_document(nodes.unionByName(G.merge_nodes(ids)), G.merge_edges(parts), F.lit(last))


@query(f"WITH {_DELETED} SELECT id, CAST(len(d) AS BIGINT) AS n_docs FROM n UNION ALL SELECT dst, count(DISTINCT doc_id) FROM e, x WHERE doc_id <> k GROUP BY 1")
def graph_delete_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[0].select("id", F.size("source_docs").cast("long").alias("n_docs"))


@query(f"WITH {_DELETED} SELECT * FROM g")
def graph_delete_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)[1].select("src", "dst", "rel", F.size("source_docs").cast("long").alias("n_docs"))


@query(
    """
    WITH p AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
    SELECT a.p AS a, b.p AS b, count(*) AS n FROM p a JOIN p b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2
    """
)
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


# A geography: region - nation - customer and supplier.
_GEO = """
    g AS (
        SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'HAS' AS rel FROM nation
        UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'HOME_OF' FROM customer
        UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'SITS_IN' FROM supplier
    ), v AS (SELECT DISTINCT unnest([src, dst]) AS id FROM g)
"""


def _geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    e = (
        n.select(key("R", "n_regionkey").alias("src"), key("N", "n_nationkey").alias("dst"), F.lit("HAS").alias("rel"))
        .union(c.select(key("N", "c_nationkey"), key("C", "c_custkey"), F.lit("HOME_OF")))
        .union(s.select(key("S", "s_suppkey"), key("N", "s_nationkey"), F.lit("SITS_IN")))
    )
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e


@query(f"WITH {_GEO} SELECT id, count(*) AS degree FROM v JOIN (SELECT unnest([src, dst]) AS id FROM g) USING (id) GROUP BY 1")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(*_geo(spark, sf_dir))


@query(
    f"""
    WITH {_GEO}, d AS (SELECT id, CAST(count(*) AS DOUBLE) AS score FROM (SELECT unnest([src, dst]) AS id FROM g) GROUP BY 1)
    SELECT id, score, row_number() OVER (ORDER BY id = 'R0' DESC, score DESC, id DESC) AS rank FROM d QUALIFY rank <= 10
    """
)
def prune_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _geo(spark, sf_dir)
    scores = G.degrees(nodes, edges).select("id", F.col("degree").cast("double").alias("score"))
    return G.prune(nodes, scores, F.lit("R0")).select("id", "score", F.col("rank").cast("long").alias("rank"))


_HOPS = f"""
    {_GEO}, b AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), h0 AS (SELECT 'R' || r_regionkey AS entry FROM region),
    h1 AS (SELECT DISTINCT entry, y AS id FROM h0 JOIN b ON x = entry),
    h2 AS (SELECT DISTINCT entry, y AS id FROM h1 JOIN b ON x = id WHERE y <> entry AND (entry, y) NOT IN (SELECT (entry, id) FROM h1))
"""


@query(f"WITH {_HOPS} SELECT entry, id, CAST(1 AS INT) AS hop FROM h1 UNION ALL SELECT entry, id, CAST(2 AS INT) FROM h2")
def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _geo(spark, sf_dir)
    entry = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("entry"))
    return G.k_hop(entry, edges, 2)


@query(
    f"""
    WITH RECURSIVE {_GEO}, d AS (SELECT DISTINCT src, dst, rel FROM g), w AS (SELECT src AS a, dst AS b, src || '>' || dst || '>' || rel AS e, rel FROM d UNION ALL SELECT dst, src, src || '>' || dst || '>' || rel, rel FROM d WHERE src <> dst),
    p AS (
        SELECT 'N' || n_nationkey AS entry, 'N' || n_nationkey AS id, 0 AS hops, ['N' || n_nationkey] AS nodes, []::VARCHAR[] AS used, []::VARCHAR[] AS rels FROM nation WHERE n_nationkey % 20 = 0
        UNION ALL SELECT entry, b, hops + 1, list_append(nodes, b), list_append(used, e), list_append(rels, rel) FROM p JOIN w ON id = a WHERE hops < 2 AND NOT list_contains(used, e)
    )
    SELECT entry, id, hops, array_to_string(nodes, '/') AS nodes, array_to_string(rels, '/') AS rels FROM p WHERE hops > 0
    """
)
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of one or two edges from every nation whose key 20 divides."""
    _, edges = _geo(spark, sf_dir)
    entry = table(spark, sf_dir, "nation").where("n_nationkey % 20 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entry"))
    return G.paths(entry, edges, 2).withColumns({c: F.array_join(c, "/") for c in ("nodes", "rels")})


@query(
    f"""
    WITH {_HOPS}, k AS (SELECT id FROM h1 WHERE entry = 'R1' UNION SELECT id FROM h2 WHERE entry = 'R1' UNION SELECT 'R1')
    SELECT DISTINCT src, dst, rel FROM g WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)
    """
)
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _geo(spark, sf_dir)
    entry = spark.range(1).select(F.lit("R1").alias("entry"))
    reached = G.k_hop(entry, edges, 2).select("id").union(entry)
    return G.induced_edges(reached, edges)


@query(
    f"""
    WITH {_HOPS}, k AS (SELECT id FROM h1 WHERE entry = 'R1' UNION SELECT id FROM h2 WHERE entry = 'R1' UNION SELECT 'R1')
    SELECT DISTINCT 'GRAPH EDGE: ' || CASE WHEN src LIKE 'N%' THEN n1.n_name ELSE src END || ' -[' || rel || ']-> ' || CASE WHEN dst LIKE 'N%' THEN n2.n_name ELSE dst END AS text
    FROM g LEFT JOIN nation n1 ON src = 'N' || n1.n_nationkey LEFT JOIN nation n2 ON dst = 'N' || n2.n_nationkey WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)
    """
)
def edge_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return G.edge_statements(induced_edges(spark, sf_dir), names).select("text").distinct()


_ROUNDS = 20
_RANK = f"""
    WITH {_GEO}, b AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), o AS (SELECT x, count(*) AS out FROM b GROUP BY 1),
    c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), r0 AS (SELECT id, 1 / n AS rank FROM v, c)
""" + "".join(
    f""", r{k + 1} AS (SELECT v.id, 0.15 / n + 0.85 * coalesce(got, 0) AS rank FROM c, v LEFT JOIN
        (SELECT y AS id, sum(rank / out) AS got FROM b JOIN o USING (x) JOIN r{k} ON r{k}.id = b.x GROUP BY 1) s USING (id))"""
    for k in range(_ROUNDS)
)


@query(f"{_RANK} SELECT id, round(rank, 8) AS rank FROM r{_ROUNDS}")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 with the operator's own number of rounds."""
    return G.pagerank(*_geo(spark, sf_dir), rounds=_ROUNDS).select("id", F.round("rank", 8).alias("rank"))


@query(
    f"""
    WITH RECURSIVE {_GEO}, b AS (SELECT src AS x, dst AS y FROM g UNION SELECT dst, src FROM g), o AS (SELECT x, count(*) AS out FROM b GROUP BY 1),
    c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), r AS (
        SELECT 0 AS k, id, 1 / n AS rank FROM v, c UNION ALL
        SELECT k + 1, y, 0.15 / any_value(n) + 0.85 * sum(rank / out) FROM r JOIN b ON r.id = b.x JOIN o ON o.x = b.x, c WHERE k < 140 GROUP BY k, y
    )
    SELECT id, round(rank, 8) AS rank FROM r WHERE k = 140
    """
)
def pagerank_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 until the ranks are settled; plain rounds, 140 of them in the SQL, come as near. Each node of this graph has an edge."""
    return G.pagerank_settled(*_geo(spark, sf_dir), tolerance=1e-10).select("id", F.round("rank", 8).alias("rank"))


# Transactions: an order line is sent by its customer; its supplier is the device, its part the card.
_TX = "t AS (SELECT l_orderkey || '-' || l_linenumber AS txn_id, 'c' || o_custkey AS f, l_suppkey AS device, l_partkey AS card FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("txn_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from"), F.col("l_suppkey").alias("device"), F.col("l_partkey").alias("card"),
    )


_HUBS = f"{_TX}, h AS (SELECT DISTINCT f AS account, 'device' AS kind, CAST(device AS VARCHAR) AS hub FROM t UNION SELECT DISTINCT f, 'card', CAST(card AS VARCHAR) FROM t)"


@query(f"WITH {_HUBS} SELECT * FROM h")
def txn_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TX.hubs(_txns(spark, sf_dir))


@query(
    f"""
    WITH {_HUBS}, a AS (SELECT 'c' || c_custkey AS account FROM customer WHERE c_custkey % 20 = 0),
    p AS (SELECT DISTINCT x.account, y.account AS peer, x.kind FROM a JOIN h x USING (account) JOIN h y ON x.kind = y.kind AND x.hub = y.hub AND x.account <> y.account)
    SELECT account, peer, kind, row_number() OVER (PARTITION BY account ORDER BY peer, kind) AS rank FROM p QUALIFY rank <= 5
    """
)
def fraud_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 for every account whose key 20 divides (the accounts asked for; peers are among all)."""
    asked = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("account"))
    return TX.rings(asked, TX.hubs(_txns(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT 'c' || o_custkey AS account, count(DISTINCT o_orderkey) AS n_txns FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 10")
def fraud_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from"), F.col("o_orderkey").alias("txn_id")
    )
    return TX.velocity(o)


@query(
    f"""
    WITH {_HUBS}, q AS (SELECT c_custkey AS qid, 'c' || c_custkey AS account FROM customer WHERE c_custkey % 20 = 0),
    p AS (SELECT DISTINCT qid, x.account, y.account AS peer, x.kind FROM q JOIN h x USING (account) JOIN h y ON x.kind = y.kind AND x.hub = y.hub AND x.account <> y.account),
    r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY peer, kind) AS n FROM p QUALIFY n <= 5)
    SELECT qid, '[FRAUD SIGNAL] Account ' || account || ' shares ' || kind || ' with account ' || peer || ' (possible collusion ring).' AS text, 'fraud:' || account || ':' || peer AS doc_id, 'fraud_graph' AS doc_type FROM r
    UNION ALL
    SELECT qid, '[FRAUD SIGNAL] Account ' || account || ' shows velocity spike: ' || count(DISTINCT txn_id) || ' outbound transactions (possible rapid-cycling fraud).', 'fraud:velocity:' || account, 'fraud_graph'
    FROM q JOIN t ON f = account GROUP BY qid, account HAVING count(DISTINCT txn_id) >= 10
    """
)
def fraud_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7 for every account whose key 20 divides."""
    asked = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("Is Account C"), F.col("c_custkey").cast("string"), F.lit(" risky?")).alias("text"))
    return TX.signals(asked, _txns(spark, sf_dir))


@query(
    f"""
    WITH {_MENTIONS}, {_EDGES}, n AS (SELECT doc_id, count(DISTINCT id) AS n FROM m GROUP BY 1), g AS (SELECT doc_id, count(DISTINCT (src, dst, type)) AS n FROM e GROUP BY 1)
    SELECT doc_id, coalesce(n.n, 0) AS n_entities, coalesce(g.n, 0) AS n_edges FROM n FULL JOIN g USING (doc_id)
    """
)
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.entity_counts(G.merge_nodes(_mentions(spark, sf_dir)), G.merge_edges(_edges(spark, sf_dir)))


@query()
def cooccurring_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 with a recogniser that takes the long words of all of a document for its entities."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), lambda x: F.length(x) >= 7))).alias("name"))
    return X.cooccurring(docs, found)
