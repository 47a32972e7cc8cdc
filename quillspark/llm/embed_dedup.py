"""Embedding near-duplicates with a robust-pruned flat graph.

Vectors are compared within a label only. Each is normalised in double precision; equal vectors of a label are one
node. Pivots fitted on a bounded sample cut a label into overlapping clusters: a node joins its ``OVERLAP`` nearest.
A cluster with more than ``MOST`` nodes is dealt by a hash into shards; the shard is what one task holds. In each
shard a graph is built by robust pruning (diversified neighbours, reverse edges added and pruned again). A node's
adjacency lists from its shards are united, and the united lists are searched: every node of a cluster goes, from the
medoid on, through each of the cluster's shards by greedy search of width ``BEAM``, which keeps on expanding while the
best open candidate is within the range (threshold less ``SLACK``). Links found are verified by their exact cosine.

A pair that shares clusters is counted in the first of them only, so counting needs no pair to leave its task; what
leaves is one count per node, and a forest of links for the components. Recall is audited against brute force over all
rows of the label for ``AUDIT`` nodes; under ``RECALL`` the search is repeated with twice the overlap and beam, and after
``ROUNDS`` rounds it fails. A search starts at the medoid and at the query's own node, and follows the united lists as
far as the shard goes: no task holds more of the graph.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, and those with a null label,
link with nothing. Vectors of another length link with those of their own length only. Rows with one vec_id are one
vector of the smallest label and components (so one row returns per vec_id); a null vec_id is dropped. Empty tables
give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import connected_components, stage, unstage

THRESHOLD, OVERLAP, TARGET, MOST, DEGREE, ALPHA, NEAREST, BEAM, SLACK = 0.93, 2, 250, 2000, 24, 1.2, 4, 48, 0.05
SAMPLE, PIVOTS, AUDIT, RECALL, ROUNDS = 20_000, 8_192, 256, 0.95, 4


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all vectors: vec_id, node) and (nodes: node, label, vec, copies); node is the smallest vec_id with that vector
    and label, null for a vector that can't link."""
    vec = F.col("embedding").cast("array<double>")
    one = vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min(F.struct(F.col("label").alias("label"), vec.alias("vec"))).alias("v")
    )
    one = one.select("vec_id", "v.label", "v.vec")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform("vec", F.abs))
    # Scaled by the largest component before squaring, so that neither very small nor very large vectors are lost.
    ok = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(top > 0, F.lit(False))
    named = one.select(
        "vec_id", "label", F.when(ok, F.transform("vec", lambda x: x / top)).alias("vec")
    )
    good = stage(named.where("vec is not null"), "vectors")
    nodes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = stage(nodes, "nodes")
    members = good.join(nodes.select("label", "vec", "node"), ["label", "vec"]).select("vec_id", "node")
    members = stage(members.union(named.where("vec is null").select("vec_id", F.lit(None).cast("long").alias("node"))), "members")
    return members, nodes


def unit(vec: pa.Array) -> np.ndarray:
    flat = np.asarray(vec.values.to_numpy(zero_copy_only=False), np.float64)
    offsets = vec.offsets.to_numpy()
    x = flat[offsets[0] : offsets[-1]].reshape(len(vec), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Pivots:
    """Unit pivots for each (label, length), at most ``PIVOTS`` in all."""

    def __init__(self, of: dict[tuple, np.ndarray]) -> None:
        self.of = of

    def nearest(self, label: object, x: np.ndarray, overlap: int) -> np.ndarray:
        p = self.of.get((label, x.shape[1]))
        if p is None or len(p) <= 1:
            return np.zeros((len(x), 1), np.int64)
        k = min(overlap, len(p))
        near = np.argpartition(-(x @ p.T), k - 1, axis=1)[:, :k]
        return np.sort(near, axis=1)


def fit_pivots(nodes: DataFrame, target: int = TARGET) -> Pivots:
    """From a sample of at most ``SAMPLE`` nodes (the first by a hash of the id), by a few rounds of means."""
    total = nodes.count()
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("label", "vec").toArrow()
    labels, out = rows.column("label").to_pylist(), {}
    vec = rows.column("vec").combine_chunks() if rows.num_rows else None
    groups: dict[tuple, list[int]] = {}
    for i, label in enumerate(labels):
        groups.setdefault((label, len(vec[i])), []).append(i)
    share = total / max(1, len(labels))
    spare = PIVOTS
    for key, at in sorted(groups.items(), key=lambda kv: str(kv[0])):
        k = min(round(len(at) * share / target), len(at), max(1, PIVOTS * len(at) // max(1, len(labels))), spare)
        x = unit(vec.take(pa.array(at)))
        if k <= 1:
            out[key] = x[:1]
            continue
        p = x[:k].copy()
        for _ in range(4):
            best = (x @ p.T).argmax(axis=1)
            new = np.zeros_like(p)
            np.add.at(new, best, x)
            size = np.linalg.norm(new, axis=1, keepdims=True)
            p = np.where(size > 1e-9, new / np.maximum(size, 1e-9), p)
        out[key] = p
        spare -= k
    return Pivots(out)


def robust_prune(x: np.ndarray, own: np.ndarray, lists: list[np.ndarray], degree: int, alpha: float) -> list[np.ndarray]:
    """Of each own node's candidates, in falling similarity: keep one if no kept one is alpha times nearer to it than the
    node is, ``degree`` at most. Distances are squared chords, 2 - 2 cos.

    Nodes of lists of like length are pruned side by side: each step keeps one candidate of every node.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lists)
    size = np.array([len(c) for c in lists])
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        width = max(1, int(size[order[min(at + 255, len(order) - 1)]]))
        some = order[at : at + max(1, min(256, 2_000_000 // (width * max(width, x.shape[1]))))]
        at += len(some)
        width = max(1, int(size[some].max()))
        cand = np.full((len(some), width), -1, np.int64)
        for r, i in enumerate(some.tolist()):
            cand[r, : size[i]] = lists[i]
        near = x[cand]
        sims = np.where(cand >= 0, np.einsum("mcd,md->mc", near, x[own[some]]), -2)
        first = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, first, axis=1), np.take_along_axis(sims, first, axis=1)
        near = np.take_along_axis(near, first[:, :, None], axis=1)
        alive, far = cand >= 0, (2 - 2 * sims) / alpha
        apart = 2 - 2 * (near @ near.transpose(0, 2, 1))
        kept = np.full((len(some), degree), -1, np.int64)
        for step in range(degree):
            rows = np.flatnonzero(alive.any(axis=1))
            if not len(rows):
                break
            best = alive[rows].argmax(axis=1)
            kept[rows, step] = cand[rows, best]
            alive[rows] &= apart[rows, best] > far[rows]
            alive[rows, best] = False
        for r, i in enumerate(some.tolist()):
            out[i] = kept[r][kept[r] >= 0]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 64) -> list[np.ndarray]:
    """Adjacency of unit vectors of one shard: candidates are the ``pool`` most similar and a spread of others."""
    n = len(x)
    if n <= degree + 1:
        return [np.delete(np.arange(n), i) for i in range(n)]
    spread = np.arange(0, n, max(1, n // 16))
    out: list[np.ndarray] = []
    for s in range(0, n, 512):
        sims = x[s : s + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        k = min(pool, n - 1)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        lists = [(c := np.union1d(near[r], spread))[c != s + r] for r in range(len(sims))]
        out += robust_prune(x, np.arange(s, s + len(sims)), lists, degree, alpha)
    # Reverse edges are added, and lists that grow too long are pruned again.
    ends, starts = np.concatenate(out), np.repeat(np.arange(n), [len(a) for a in out])
    by_end = np.argsort(ends, kind="stable")
    reverse = np.split(starts[by_end], np.cumsum(np.bincount(ends, minlength=n))[:-1])
    out = [np.union1d(a, b) for a, b in zip(out, reverse, strict=True)]
    long = np.array([i for i in range(n) if len(out[i]) > degree], np.int64)
    for i, a in zip(long.tolist(), robust_prune(x, long, [out[i] for i in long], degree, alpha), strict=True):
        out[i] = a
    # Pruning leaves some nodes of dense groups without an edge that leads to them: each gets one from its nearest.
    for i in range(n):
        v = x[out[i]] @ x[i]
        for j in out[i][np.argsort(-v, kind="stable")[:NEAREST]].tolist():
            if i not in out[j]:
                out[j] = np.append(out[j], i)
    return out


def range_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float, beam: int, slack: float = SLACK, wide: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, nodes, cosines) at or above the threshold, query by query.

    adj: padded with -1. own: each query's node in this graph (-1: none), a second place to start from beside the
    medoid. Queries move together: in each step every open query expands its ``wide`` best open nodes; it
    is done when it has expanded ``beam`` nodes at least and its best open one is below the range.
    """
    n = len(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    for s in range(0, len(q), 128):
        part = q[s : s + 128]
        m = len(part)
        seen = np.full((m, n), -2.0, np.float32)  # similarity of what was reached
        open_ = np.full((m, n), -2.0, np.float32)  # of what was reached and not expanded
        seen[:, medoid] = open_[:, medoid] = part @ x[medoid]
        inside = np.flatnonzero(own[s : s + m] >= 0)
        seen[inside, own[s : s + m][inside]] = open_[inside, own[s : s + m][inside]] = 1.0
        done, expanded = np.zeros(m, bool), np.zeros(m, np.int64)
        k = min(wide, n)
        while True:
            live = np.flatnonzero(~done)
            if not len(live):
                break
            now = open_[live]
            best = np.argpartition(-now, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(now, best, axis=1)
            top = value.max(axis=1)
            end = (top < -1.5) | ((expanded[live] >= beam) & (top < threshold - slack))
            done[live[end]] = True
            ok = (value > -1.5) & ~end[:, None] & ((value >= threshold - slack) | (expanded[live] < beam)[:, None])
            r, c = np.nonzero(ok)
            if not len(r):
                done[live] = True
                break
            rows, node = live[r], best[r, c]
            expanded += np.bincount(rows, minlength=m)
            open_[rows, node] = -2
            nb = adj[node]
            rr, cc = np.nonzero(nb >= 0)
            pr, pn = rows[rr], nb[rr, cc]
            new = seen[pr, pn] < -1.5
            pr, pn = pr[new], pn[new]
            key = np.unique(pr * n + pn)
            pr, pn = key // n, key % n
            v = np.einsum("ij,ij->i", part[pr], x[pn])
            seen[pr, pn] = v
            open_[pr, pn] = v
        for i in range(m):
            near = np.flatnonzero(seen[i] >= threshold - 1e-4)
            exact = x[near] @ part[i]
            good = exact >= threshold
            yield s + i, near[good], exact[good]


def _sharded(nodes: DataFrame, pivots: Pivots, overlap: int) -> DataFrame:
    """(node, label, dim, vec, cluster, clusters): a row for each cluster that a node is in."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)
    label = nodes.schema["label"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            vec = batch.column(2)
            dims = np.diff(vec.offsets.to_numpy())
            groups: dict[tuple, list[int]] = {}
            for i, (a, d) in enumerate(zip(labels, dims.tolist(), strict=True)):
                groups.setdefault((a, d), []).append(i)
            for (a, d), at in groups.items():
                own = batch.take(pa.array(at))
                near = shared.value.nearest(a, unit(own.column(2)), overlap)
                k = near.shape[1]
                rows = own.take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.full(len(at) * k, d, np.int32)), pa.array(near.ravel()), pa.array(np.repeat(near, k, axis=0).tolist(), pa.list_(pa.int64()))],
                    names=["node", "label", "vec", "copies", "dim", "cluster", "clusters"],
                )

    return nodes.select("node", "label", "vec", "copies").mapInArrow(
        each,
        f"node long, label {label}, vec array<double>, copies long, dim int, cluster long, clusters array<bigint>",
    )


def _shard_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The shards of a partition that is sorted by ``key``; each is bounded by how it was dealt."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = np.array(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            if part.num_rows and held and held[-1].column(held[-1].schema.get_field_index(key))[0] != part.column(part.schema.get_field_index(key))[0]:
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def near_links(nodes: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM, pivots: Pivots | None = None) -> DataFrame:
    """Rows (node, links, to): with ``to`` null, how many other vectors a node is linked to in a shard; with ``to``, a
    node that it is connected to (a forest for each shard)."""
    pivots = pivots or fit_pivots(nodes)
    first = stage(_sharded(nodes, pivots, overlap), "placed")
    cluster = ["label", "dim", "cluster"]
    sizes = first.groupBy(*cluster).agg(F.count("*").alias("n"))
    sizes = stage(sizes.select(*cluster, F.greatest(F.lit(1), F.ceil(F.col("n") / MOST)).cast("int").alias("shards")), "sizes")
    placed = first.join(sizes, cluster).withColumns({
        "home": F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"),
        "block": F.pmod(F.xxhash64("node", F.lit("block")), F.col("shards")).cast("int"),
    })
    placed = stage(placed, "placed")
    unstage(first)
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    key = [F.col(c) for c in cluster]
    carried = ["node", "vec", "copies", "clusters", "cluster"]
    # A group of the search is a shard's members and one block of the cluster's nodes as queries: both are bounded.
    members = placed.withColumn("at", every).select(
        F.xxhash64(*key, "home", "at").alias("shard"), *carried, F.lit(True).alias("member"), (F.col("at") == F.col("block")).alias("query")
    )
    visits = placed.where("shards > 1").withColumn("at", every).where("at <> home").select(
        F.xxhash64(*key, "at", "block").alias("shard"), *carried, F.lit(False).alias("member"), F.lit(True).alias("query")
    )
    built = placed.select(F.xxhash64(*key, "home").alias("shard"), "node", "vec")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shard_groups(batches, "shard"):
            ids = t.column("node").to_numpy()
            adj = build_graph(unit(t.column("vec").combine_chunks()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([ids[a].tolist() for a in adj], pa.list_(pa.int64()))], names=["node", "adjacent"]
            )

    graph = (
        built.repartition("shard").sortWithinPartitions("shard", "node")
        .mapInArrow(build, "node long, adjacent array<bigint>")
        .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("adjacent"))).alias("adjacent"))
    )
    graph = stage(graph, "graph")
    with_graph = members.join(graph, "node", "left")
    rows = with_graph.unionByName(visits, allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shard_groups(batches, "shard"):
            member = np.array(t.column("member"))
            ids, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
            x = unit(t.column("vec").combine_chunks())
            base = np.flatnonzero(member)
            if not len(base):
                continue
            order = np.argsort(ids[base])
            base = base[order]
            own_ids = ids[base]
            lists = t.column("adjacent").combine_chunks().take(pa.array(base))
            flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.int64)
            off = lists.offsets.to_numpy()
            flat = flat[off[0] : off[-1]]
            owner = np.repeat(np.arange(len(base)), np.diff(off))
            at = np.minimum(np.searchsorted(own_ids, flat), len(own_ids) - 1)
            here = own_ids[at] == flat  # united lists name nodes of other shards too
            owner, at = owner[here], at[here]
            deg = np.bincount(owner, minlength=len(base))
            adj = np.full((len(base), max(1, deg.max())), -1, np.int64)
            adj[owner, np.arange(len(owner)) - np.repeat(np.cumsum(deg) - deg, deg)] = at
            clusters = t.column("clusters").to_pylist()
            here_cluster = t.column("cluster")[0].as_py()
            width = max(map(len, clusters))
            sets = np.array([c + [-1 - i % 2] * (width - len(c)) for i, c in enumerate(clusters)], np.int64)
            out_node, out_n, out_to = [], [], []
            asks = np.flatnonzero(np.array(t.column("query")))
            place = np.full(len(ids), -1)
            place[base] = np.arange(len(base))
            group = np.arange(len(ids))  # what the links of this shard connect
            for k, found, _ in range_search(x[base], adj, x[asks], place[asks], threshold, beam):
                i, other = asks[k], base[found]
                other = other[ids[other] != ids[i]]
                if not len(other):
                    continue
                met = np.unique(np.append(group[other], group[i]))
                if len(met) > 1:
                    group[np.isin(group, met)] = met[0]
                mine = set(clusters[i])
                lower = [c for c in mine if c < here_cluster]
                if lower:  # a pair that meets in an earlier cluster is counted there
                    other = other[~np.isin(sets[other], lower).any(axis=1)]
                    if not len(other):
                        continue
                out_node.append(int(ids[i]))
                out_n.append(int(copies[other].sum()))
                out_to.append(None)
            moved = np.flatnonzero(group != np.arange(len(ids)))
            out_node += ids[moved].tolist()
            out_n += [0] * len(moved)
            out_to += ids[group[moved]].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_node, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_to, pa.int64())],
                names=["node", "links", "to"],
            )

    found = rows.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(search, "node long, links long, to long")
    return stage(found, "links")


def brute_links(nodes: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(node, links) of the asked nodes, at most ``AUDIT``, against all nodes of their labels."""
    rows = asked.limit(AUDIT).select("node", "label", "vec").collect()
    asks: dict[tuple, tuple[list, list]] = {}
    for r in rows:
        ids, vecs = asks.setdefault((r.label, len(r.vec)), ([], []))
        ids.append(r.node), vecs.append(r.vec)
    ready = {k: (np.array(i), np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)) for k, (i, v) in asks.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(ready)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            dims = np.diff(batch.column(2).offsets.to_numpy())
            for (label, dim), (ids, q) in shared.value.items():
                at = np.flatnonzero((labels == label) & (dims == dim))
                if not len(at):
                    continue
                own = batch.take(pa.array(at))
                hit = (unit(own.column(2)) @ q.T >= threshold) & (own.column(0).to_numpy()[:, None] != ids[None])
                n = (hit * own.column(3).to_numpy()[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["node", "links"])

    counted = nodes.select("node", "label", "vec", "copies").mapInArrow(each, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD) -> float:
    """Recall against brute force over ``AUDIT`` nodes, the first by a hash of the id: the smaller one of the share of
    their links that was found and of the mean of each node's share, so that neither large groups nor lone pairs hide."""
    asked = stage(nodes.orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(AUDIT), "asked")
    both = brute_links(nodes, asked, threshold).withColumnRenamed("links", "real").join(counts, "node", "left").where("real > 0")
    got = F.coalesce("links", F.lit(0))
    r = both.agg(F.sum(got) / F.sum("real"), F.avg(got / F.col("real"))).first()
    return min(1.0 if x is None else float(x) for x in r)


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    members, nodes = nodes_of(vectors)
    pivots = fit_pivots(nodes)
    for _ in range(ROUNDS):
        found = near_links(nodes, threshold, overlap, beam, pivots)
        counts = stage(found.where("to is null").groupBy("node").agg(F.sum("links").alias("links")), "counts")
        recall = audit(nodes, counts, threshold)
        if recall >= RECALL:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        raise RuntimeError(f"recall {recall:.3f} is under {RECALL} after {ROUNDS} rounds")
    cc = connected_components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    of = nodes.select("node", "copies").join(counts, "node", "left").join(cc, "node", "left").select(
        "node",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    of = stage(of, "linked")
    out = members.join(of, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
