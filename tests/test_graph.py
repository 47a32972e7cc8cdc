"""Graph operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph as G

#: Six stops and the lines between them; nothing goes to solo.
NODES = ["hub", "east", "west", "north", "ring", "solo"]
EDGES = [("hub", "east"), ("hub", "west"), ("east", "west"), ("west", "north"), ("north", "ring"), ("hub", "ring"), ("ring", "west")]


def tables(spark):
    return spark.createDataFrame([(n,) for n in NODES], "id string"), spark.createDataFrame(EDGES, "src string, dst string")


def test_prune_orders_by_score_then_id_behind_the_entry(spark):
    nodes, edges = tables(spark)
    degree = G.degrees(nodes, edges)
    assert {r.id: r.degree for r in degree.collect()} == {"hub": 3, "east": 2, "west": 4, "north": 2, "ring": 3, "solo": 0}
    scores = degree.select("id", F.col("degree").cast("double").alias("score"))
    for entry, n, want in (("hub", 4, ["hub", "west", "ring", "north"]), ("solo", 3, ["solo", "west", "ring"]), ("north", 2, ["north", "west"])):
        assert [r.id for r in G.prune(nodes, scores, F.lit(entry), n).orderBy("rank").collect()] == want
    assert G.prune(nodes, scores, F.lit("hub"), 0).count() == len(NODES)


def test_delete_document_keeps_what_others_share(spark):
    nodes = spark.createDataFrame([("x", ["d1", "d2"]), ("y", ["d1"]), ("z", ["d2"])], "id string, source_docs array<string>")
    edges = spark.createDataFrame([("x", "y", "R", ["d1"]), ("x", "z", "R", ["d1", "d2"]), ("y", "z", "R", ["d2"])], "src string, dst string, rel string, source_docs array<string>")
    n, e = G.delete_document(nodes, edges, F.lit("d1"))
    assert sorted(r.id for r in n.collect()) == ["x", "z"]
    assert [(r.src, r.dst, r.source_docs) for r in e.collect()] == [("x", "z", ["d2"])]


def test_merge_edges_drops_loops_and_makes_names_safe(spark):
    e = spark.createDataFrame([("a", "a", "r", 1), ("a", "b", "caused by", 1), ("a", "b", "caused-by", 2), ("a", None, "r", 1)], "src string, dst string, type string, doc_id int")
    assert [tuple(r) for r in G.merge_edges(e).collect()] == [("a", "b", "CAUSED_BY", [1, 2])]


def test_hops_and_pagerank(spark):
    nodes, edges = tables(spark)
    entry = spark.createDataFrame([("east",)], "entry string")
    assert {(r.id, r.hop) for r in G.k_hop(entry, edges, 2).collect()} == {("hub", 1), ("west", 1), ("ring", 2), ("north", 2)}
    rank = {r.id: r["rank"] for r in G.pagerank(nodes, edges, 30).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["west"] == max(rank.values()) and rank["solo"] == min(rank.values())
    near = {n: {b for a, b in EDGES if a == n} | {a for a, b in EDGES if b == n} for n in NODES}
    for n in NODES:  # settled: each rank is what its neighbours and the stop without lines send
        got = sum(rank[m] / len(near[m]) for m in near[n]) + rank["solo"] / len(NODES)
        assert abs(rank[n] - (0.15 / len(NODES) + 0.85 * got)) < 2e-3


def test_entry_and_subgraph(spark):
    nodes = spark.createDataFrame([("bug-204", "checkout bug"), ("svc", "checkout service"), ("x", "other")], "id string, name string")
    edges = spark.createDataFrame([("bug-204", "svc", "AFFECTS"), ("svc", "x", "USES")], "src string, dst string, rel string")
    q = spark.createDataFrame([(1, "who owns the checkout service"), (2, "unknown words")], "qid int, text string")
    kept, inside = G.subgraph(q, nodes, edges, 1)
    assert [r.id for r in kept.where("qid = 1").orderBy("rank").collect()] == ["svc", "x", "bug-204"]
    assert {(r.src, r.dst) for r in inside.where("qid = 1").collect()} == {("bug-204", "svc"), ("svc", "x")}
    assert kept.where("qid = 2").count() > 0  # no token of it is known: the nearest node by vector


def test_cooccurrence(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (3, "c")], "g int, x string")
    assert [tuple(r) for r in G.cooccurrence(rows, "g", "x").collect()] == [("a", "b", 2)]


def settled(nodes, edges, damping=0.85):
    """Power iteration until nothing moves."""
    near = {v: set() for v in nodes}
    for a, b in edges:
        if a != b and a in near and b in near:
            near[a].add(b), near[b].add(a)
    x = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(400):
        stuck = sum(x[v] for v in nodes if not near[v])
        x = {v: (1 - damping) / len(nodes) + damping * (stuck / len(nodes) + sum(x[u] / len(near[u]) for u in near[v])) for v in nodes}
    return x


def test_settled_ranks(spark):
    import random

    r = random.Random(4)
    star = (list("habcdef"), [("h", x) for x in "abcdef"])
    two_sides = ([f"{s}{i}" for s in "lr" for i in range(12)], [(f"l{r.randrange(12)}", f"r{r.randrange(12)}") for _ in range(30)])
    loose = ([str(i) for i in range(30)], [(str(r.randrange(20)), str(r.randrange(20))) for _ in range(25)] + [("1", "1"), ("1", "unknown"), ("2", "1"), ("1", "2")])
    for nodes, edges in (star, two_sides, loose):
        frames = spark.createDataFrame([(v,) for v in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")
        got = {x.id: x["rank"] for x in G.pagerank_settled(*frames).collect()}
        want = settled(nodes, edges)
        assert got.keys() == want.keys() and sum(abs(got[v] - want[v]) for v in want) < 1e-6
        assert abs(sum(got.values()) - 1) < 1e-6


def test_settled_ranks_of_edges_and_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    alone = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    assert {x.id: x["rank"] for x in G.pagerank_settled(alone, none).collect()} == {"a": 0.5, "b": 0.5}
    assert G.pagerank_settled(alone.where("id = 'z'"), none).count() == 0
    pair = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    three = spark.createDataFrame([(x,) for x in "abc"], "id string")
    with pytest.raises(RuntimeError):
        G.pagerank_settled(three, pair, tolerance=1e-12, most=8).count()


def test_paths_use_no_relationship_twice(spark):
    edges = [("a", "b", "R"), ("a", "b", "S"), ("b", "c", "R"), ("c", "a", "R"), ("c", "c", "LOOP"), ("x", "y", "R"), ("a", "b", "R"), (None, "a", "R")]
    found, kinds = [], sorted({e for e in edges if None not in e})
    for entry in ("a", "x", "nowhere"):
        todo = [(entry, (entry,), ())]
        while todo:
            at, nodes, used = todo.pop()
            if used:
                found.append((entry, at, len(used), nodes, tuple(e[2] for e in used)))
            if len(used) < 3:
                for e in kinds:
                    for to in {e[1] if e[0] == at else None, e[0] if e[1] == at else None} - {None}:
                        if e not in used:
                            todo.append((to, (*nodes, to), (*used, e)))
    entries = spark.createDataFrame([("a",), ("x",), ("nowhere",), ("a",), (None,)], "entry string")
    got = [(r.entry, r.id, r.hops, tuple(r.nodes), tuple(r.rels)) for r in G.paths(entries, spark.createDataFrame(edges, "src string, dst string, rel string"), 3).collect()]
    assert sorted(got) == sorted(found) and len(found) > 15


def test_rounds_of_settled_ranks_leave_leaves_out(spark, monkeypatch):
    """Two hubs, a ring of three, a pair and a node alone: 300 of 309 nodes have one neighbour."""
    edges = [(f"h{i % 2}", f"leaf{i}") for i in range(300)] + [("h0", "h1"), ("h1", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("p", "q")]
    nodes = sorted({x for e in edges for x in e} | {"solo"})
    sizes, stage = {}, G.stage

    def counting(df, tag):
        out = stage(df, tag)
        sizes[tag] = max(sizes.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(G, "stage", counting)
    frames = spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")
    got = {x.id: x["rank"] for x in G.pagerank_settled(*frames, tolerance=1e-10).collect()}
    want = settled(nodes, edges)
    assert set(got) == set(want) and sum(abs(got[x] - want[x]) for x in want) < 1e-9
    assert sizes["rank"] == 6 and sizes["links"] < 30
