"""The entity graph: merging nodes and edges, deleting documents, neighbourhoods, centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark import constants as C
from quillspark.functions import text as T
from quillspark.functions.vectors import cosine, hash_embed
from quillspark.operators.matching import containing
from quillspark.operators.ranking import first_per, top_per
from quillspark.operators.search import top_k
from quillspark.operators.sparse_index import build_index, sparse_top_k
from quillspark.staging import stage


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """K3: one node for each id from mentions (id, name, type, doc_id, ord[, profile]).

    Name and type are the first mention's, the profile the last one's; aliases and source documents are sorted sets.
    """
    profile = [F.max_by("profile", "ord").alias("profile")] if "profile" in mentions.columns else []
    return mentions.groupBy("id").agg(
        F.min_by("name", "ord").alias("name"),
        F.min_by("type", "ord").alias("type"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
        F.array_sort(F.collect_set("doc_id")).alias("source_docs"),
        *profile,
    )


def resolve_edges(edges: DataFrame, resolver: DataFrame) -> DataFrame:
    """Endpoints by name to ids (resolver: name, id); an edge with an unknown end is dropped."""
    s = resolver.select(F.col("name").alias("source"), F.col("id").alias("src"))
    d = resolver.select(F.col("name").alias("target"), F.col("id").alias("dst"))
    return edges.join(s, "source").join(d, "target").drop("source", "target")


def merge_edges(edges: DataFrame) -> DataFrame:
    """K4: (src, dst, rel, source_docs) from (src, dst, type, doc_id): no self-loops, relation names made safe."""
    return (
        edges.where("src <> dst and src is not null and dst is not null")
        .withColumn("rel", T.relation_type(F.col("type")))
        .groupBy("src", "dst", "rel")
        .agg(F.array_sort(F.collect_set("doc_id")).alias("source_docs"))
    )


def delete_document(nodes: DataFrame, edges: DataFrame, doc: Column) -> tuple[DataFrame, DataFrame]:
    """K5: the document is taken off every list; nodes and edges with an empty list go, and edges of nodes that go."""

    def left(df: DataFrame) -> DataFrame:
        return df.withColumn("source_docs", F.array_remove("source_docs", doc)).where(F.size("source_docs") > 0)

    nodes, edges = left(nodes), left(edges)
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return nodes, kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def cooccurrence(items: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, n) with a < b: pairs of distinct items of one group and in how many groups they are.

    A group's pairs are formed from its own sorted set, so a group costs its pairs and no join is skewed by it. Pairs
    are made item by item and counted as they come: a task holds a group's set, never its pairs.
    """
    sets = items.select(key, item).distinct().groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("s"))
    first = sets.where(F.size("s") > 1).select("s", F.posexplode("s").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge rows at each node of the set; several edges count each."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = C.PAGERANK_DAMPING, stage_every: int = 5) -> DataFrame:
    """Over the undirected simple graph, a fixed number of rounds. Nodes without edges spread evenly.

    Links and every few rounds' ranks are staged tables, so no plan grows with the rounds.
    """
    ids = nodes.select("id").distinct()
    pairs = both_ways(edges.where("src <> dst")).distinct()
    pairs = pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out_degree = pairs.groupBy("src").agg(F.count("*").alias("out"))
    ids = stage(ids, "ids")
    links = stage(pairs.join(out_degree, "src"), "links")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    lonely = stage(ids.join(links.select(F.col("src").alias("id")), "id", "left_anti"), "lonely")
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        spread = links.join(rank.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("rank") / F.col("out")).alias("got")
        )
        stuck = lonely.join(rank, "id").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("stuck"))
        rank = (
            ids.join(spread, "id", "left")
            .join(F.broadcast(stuck))  # one row
            .select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("stuck") / n)).alias("rank"))
        )
        if (k + 1) % stage_every == 0 and k + 1 < rounds:
            rank = stage(rank, "rank")
    return rank


def pagerank_settled(
    nodes: DataFrame, edges: DataFrame, tolerance: float = C.PAGERANK_TOLERANCE, most: int = C.PAGERANK_ROUNDS, damping: float = C.PAGERANK_DAMPING, stage_every: int = 4,
) -> DataFrame:
    """A7 to tolerance: (id, rank) within ``tolerance`` of the settled ranks, over all nodes together (L1).

    Nodes push what they have not sent yet: a change too small to matter waits until it has grown (all that waits is part
    of the bound). A round's residuals move the ranks by the Chebyshev step, which fits an undirected graph, whose walk
    has real eigenvalues: some 30 rounds at 0.85 where plain rounds need 97, also where these oscillate (bipartite
    graphs). Nodes without edges have a closed form. Rounds end when residual and waiting pushes bound the error by the
    tolerance; RuntimeError after ``most`` rounds.

    A node with one neighbour is a leaf: its rank follows from its neighbour's, so a neighbour's leaves are one link to itself
    (which keeps the eigenvalues real and the bound) and rounds see the other nodes only. Of a pair of nodes that have
    each other only, the larger is the leaf.

    A round is one join with the links and one sum by node; a node's own row travels as a link to itself, so a round
    reads the round before once. Every few rounds are staged.
    """
    ids = stage(nodes.select("id").where("id is not null").distinct(), "ids")
    pairs = both_ways(edges.where("src <> dst")).distinct()
    pairs = pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = stage(pairs, "pairs")
    degrees = stage(pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"), F.min("dst").alias("other")), "degrees")
    leaves = degrees.where("out = 1").groupBy(F.col("other").alias("id")).agg(F.count("*").alias("leaves"))
    met = stage(degrees.join(leaves, "id", "left").withColumn("core", F.expr("out > 1 or leaves is not null and id < other")), "met")
    core = met.where("core").select("id", "out", F.coalesce("leaves", F.lit(0)).alias("leaves"))
    n, linked = ids.count(), degrees.count()
    lonely = n - linked
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    alone = (1 - damping) / (n - damping * lonely) if lonely else 0.0  # the rank of each node without edges
    base, small = (1 - damping) / n + damping * alone * lonely / n, tolerance * (1 - damping) / (4 * n)
    inner = pairs.join(core.select(F.col("id").alias("dst")), "dst", "left_semi").join(core.withColumnRenamed("id", "src"), "src")
    to_self = lambda rows, weight: rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), weight.alias("weight"))
    links = inner.select("src", "dst", (1 / F.col("out")).alias("weight"))
    links = links.union(to_self(core.where("leaves > 0"), damping * F.col("leaves") / F.col("out"))).union(to_self(core, F.lit(None).cast("double")))
    links = stage(links, "links")
    state = core.select(
        "id", F.lit(1.0 / n).alias("x"), F.lit(1.0 / n).alias("before"), (F.lit(base) * (1 + damping * F.col("leaves"))).alias("got"), F.lit(1.0 / n).alias("wait"), F.lit(0.0).alias("residual")
    )
    omega, error = 1.0, float("inf") if linked else 0.0
    for k in range(most):
        if error <= tolerance:
            break
        omega = 1 / (1 - damping**2 * omega / (2 if k == 1 else 4)) if k else 1.0
        sent = F.when(F.abs("wait") > small, F.col("wait")).otherwise(0.0)
        keep = lambda c: F.max(F.when(F.col("weight").isNull(), c))
        got = state.join(links, state["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(
            keep(F.col("x")).alias("x"), keep(F.col("before")).alias("before"), keep(F.col("wait") - sent).alias("wait"),
            (keep(F.col("got")) + damping * F.coalesce(F.sum(sent * F.col("weight")), F.lit(0.0))).alias("got"),
        )
        moved = got.withColumn("residual", F.col("got") - F.col("x")).withColumn("new", omega * (F.col("residual") + F.col("x") - F.col("before")) + F.col("before"))
        state = moved.select("id", F.col("new").alias("x"), F.col("x").alias("before"), "got", (F.col("wait") + F.col("new") - F.col("x")).alias("wait"), "residual", F.abs("wait").alias("held"))
        if (k + 1) % stage_every == 0 or k + 1 == most:
            state = stage(state, "rank")
            r = state.agg(F.sum(F.abs("residual")), F.sum("held")).first()
            error = (r[0] + damping * r[1]) / (1 - damping)
    if error > tolerance:
        raise RuntimeError(f"ranks are within {error} after {most} rounds, not within {tolerance}")
    # The residual is that of the ranks before the last step.
    ranks = state.select("id", F.col("before").alias("rank"))
    sends = ranks.join(core, "id").select(F.col("id").alias("other"), (F.lit(base) + damping * F.col("rank") / F.col("out")).alias("rank"))
    hanging = met.where("not core").select("id", "other").join(sends, "other").select("id", "rank")
    rest = ids.join(degrees, "id", "left_anti").select("id", F.lit(alone).alias("rank"))
    return ranks.union(hanging).union(rest)


def prune(nodes: DataFrame, scores: DataFrame, entry: Column, n: int = C.PRUNE_TOP, keys: list[str] = ()) -> DataFrame:
    """The entry first, then by score and id, both falling; n in all, or all where n is not positive.

    scores: (id, score). keys: columns that tell several subgraphs apart.
    """
    keys = list(keys)
    scored = nodes.join(scores, [*keys, "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if n <= 0:
        return scored
    order = [(F.col("id") == entry).desc(), F.col("score").desc(), F.col("id").desc()]
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    if not keys:
        return scored.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(w))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def k_hop(entries: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(entry, id, hop): nodes within ``hops`` undirected steps of each entry, at their first hop; not the entry.

    The frontier is joined with the edges hop by hop, and only nodes not yet reached go on.
    """
    pairs = both_ways(edges).where("src <> dst").distinct()
    seen = entries.select("entry", F.col("entry").alias("id"), F.lit(0).alias("hop"))
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.select("entry", F.col("id").alias("src")).join(pairs, "src").select("entry", F.col("dst").alias("id"))
        frontier = step.distinct().join(seen.select("entry", "id"), ["entry", "id"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.union(frontier)
    return seen.where("hop > 0")


def paths(entries: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(entry, id, hops, nodes, rels) of every path of 1 to ``hops`` edges from each entry, edges taken either way.

    A path uses no relationship twice but may pass a node again, as patterns of variable length do; parallel edges give
    paths of their own. edges: (src, dst, rel); equal rows are one relationship, ids and relations null-free. A hop is
    one join of the paths so far with the edges at their ends, so the plan has as many joins as hops.
    """
    ways = edges.where("src is not null and dst is not null").select("src", "dst", "rel").distinct()
    there = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "rel")
    back = ways.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), there.alias("edge"))
    ways = ways.select(F.col("src").alias("at"), F.col("dst").alias("to"), there.alias("edge")).union(back)
    now = entries.where("entry is not null").select("entry").distinct()
    now = now.select("entry", F.col("entry").alias("id"), F.array("entry").alias("nodes"), F.array().cast(f"array<{ways.schema['edge'].dataType.simpleString()}>").alias("used"))
    out = None
    for _ in range(hops):
        met = now.join(ways, now["id"] == ways["at"]).where(~F.array_contains("used", F.col("edge")))
        now = met.select("entry", F.col("to").alias("id"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("used", F.col("edge")).alias("used"))
        now = stage(now, "paths")
        out = now if out is None else out.union(now)
    return out.select("entry", "id", F.size("used").alias("hops"), "nodes", F.transform("used", lambda e: e["rel"]).alias("rels"))


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst, rel) between nodes of the set. The edge's own direction is kept."""
    ids = nodes.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    return inside.where("src <> dst").select("src", "dst", "rel").distinct()


def edge_statements(edges: DataFrame, names: DataFrame) -> DataFrame:
    """T22: 'GRAPH EDGE: A -[REL]-> B' with names where they are known."""
    s = names.select(F.col("id").alias("src"), F.col("name").alias("_s"))
    d = names.select(F.col("id").alias("dst"), F.col("name").alias("_d"))
    full = edges.join(s, "src", "left").join(d, "dst", "left")
    text = F.concat(
        F.lit(C.EDGE_TAG + " "), F.coalesce("_s", F.col("src").cast("string")), F.lit(" -["), F.col("rel"), F.lit("]-> "),
        F.coalesce("_d", F.col("dst").cast("string")),
    )
    return full.select(text.alias("text"), F.lit("graph_edge").alias("doc_type"), "src", "dst", "rel")


def _asked_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))


def substring_candidates(queries: DataFrame, nodes: DataFrame, most: int = 8, limit: int = C.GRAPH_LIMIT) -> DataFrame:
    """(qid, id): the first nodes by id whose id or name contains one of a query's first ``most`` tokens."""
    first = F.slice(F.array_distinct(T.tokens(F.col("text"))), 1, most)
    asked = queries.select("qid", F.explode(first).alias("token"))
    said = nodes.select("id", F.explode(F.array_distinct(F.array(F.lower(F.col("id").cast("string")), F.lower(F.coalesce("name", F.lit("")))))).alias("said"))
    met = containing(asked.select("token").distinct(), said, "token", "said").select("token", "id").distinct()
    return top_per(asked.join(met, "token").select("qid", "id").distinct(), ["qid"], [F.col("id")], limit, "_n").drop("_n")


def entry_by_keyword(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, id, overlap): the node that shares most tokens with the query.

    By the index of ids' and names' tokens: the lists of a query's rare tokens are read first, and a common token's list
    only if it can still decide.
    """
    own = F.array_distinct(T.tokens(F.concat_ws(" ", F.col("id").cast("string"), "name")))
    said = nodes.select(F.lit(0).alias("coll"), "id", F.explode(own).alias("idx"), F.lit(1.0).alias("tf")).distinct()
    asked = _asked_tokens(queries).select("qid", F.col("token").alias("idx"), F.lit(1.0).alias("weight"))
    return sparse_top_k(asked, build_index(said), 1).select("qid", "id", F.col("score").cast("long").alias("overlap"))


def entry_by_vector(queries: DataFrame, nodes: DataFrame, embed=hash_embed) -> DataFrame:
    """(qid, id, score): the node whose name is nearest to the query: of those that contain one of its tokens, or
    of all where none does. A node without a name goes by its id."""
    named = nodes.select("id", embed(F.coalesce("name", F.col("id").cast("string"))).alias("vector"))
    asked = queries.select("qid", embed(F.col("text")).alias("asked"))
    near = substring_candidates(queries, nodes)
    own = near.join(named, "id").join(asked, "qid").select("qid", "id", F.round(cosine(F.col("asked"), F.col("vector")), 6).alias("score"))
    rest = asked.join(near.select("qid").distinct(), "qid", "left_anti").withColumnRenamed("asked", "vector")
    both = own.unionByName(top_k(rest, named, 1).select("qid", "id", "score"))
    return first_per(both, ["qid"], [F.col("score").desc(), F.col("id")])


def choose_entry(by_keyword: DataFrame, by_vector: DataFrame, least: int = C.KEYWORD_OVERLAP) -> DataFrame:
    """The keyword's entry from an overlap of two, else the vector's, else the keyword's."""
    both = by_keyword.withColumnRenamed("id", "k").join(by_vector.select("qid", F.col("id").alias("v")), "qid", "full")
    return both.select("qid", F.when(F.col("overlap") >= least, F.col("k")).otherwise(F.coalesce("v", "k")).alias("entry"))


def subgraph(queries: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 2, n: int = C.PRUNE_TOP, strategy: str = "keyword", embed=hash_embed) -> tuple[DataFrame, DataFrame]:
    """R2: each query's entry, its neighbourhood pruned by degree, and the edges inside it.

    strategy: ``keyword`` and ``hybrid`` take the keyword's entry from an overlap of two, else the vector's; ``vector``
    only that. Returns (qid, id, name, rank) and (qid, src, dst, rel).
    """
    vector = entry_by_vector(queries, nodes, embed)
    if strategy == "vector":
        entry = vector.select("qid", F.col("id").alias("entry"))
    else:
        entry = choose_entry(entry_by_keyword(queries, nodes), vector)
    entry = stage(entry, "entries")  # read once for each hop and end
    reached = k_hop(entry.select("entry").distinct(), edges, hops).select("entry", "id")
    members = reached.union(entry.select("entry", F.col("entry").alias("id")).distinct())
    inside = (
        edges.join(members.select("entry", F.col("id").alias("src")), "src")
        .join(members.select("entry", F.col("id").alias("dst")), ["entry", "dst"])
        .select("entry", "src", "dst", "rel").distinct()
    )
    degree = inside.select("entry", F.explode(F.array("src", "dst")).alias("id")).groupBy("entry", "id").agg(
        F.count("*").cast("double").alias("score")
    )
    kept = prune(members, degree, F.col("entry"), n, ["entry"])
    inner = kept.select("entry", F.col("id").alias("src"))
    inside = inside.join(inner, ["entry", "src"], "left_semi").join(inner.withColumnRenamed("src", "dst"), ["entry", "dst"], "left_semi")
    named = kept.join(nodes.select("id", "name"), "id", "left")
    return entry.join(named, "entry").select("qid", "id", "name", "rank"), entry.join(inside, "entry").select("qid", "src", "dst", "rel")
