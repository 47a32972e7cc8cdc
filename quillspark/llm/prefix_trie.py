"""Conversation prefix trie: which conversations begin alike, and how many words a shared prefix saves.

Conversations come in families: ids that share a base id, ``conv_id - conv_id % family``. One of them is rebuilt as the
first turns of the base followed by its own ones. Family first: each family is one small trie, made in one group from
digests of turns and numbers of words (texts stay behind); only the nodes of these tries are shuffled, one row a family
and node, to be merged with those of other families. A node is the chained digest of its turns, so nodes of equal
prefixes meet by equality.

Sums over subtrees come family first too. Each merged node goes back to the family of its smallest conversation, whose
small trie has the whole path to it; the family adds up along its paths, and sends one row for each of its own nodes. So
work is linear in the turns, however deep the trie is, and there is a fixed number of shuffles.

The conversations that end at a node are hashed in the order of their ids: range-sorted, joined into chunks of ``CHUNK``
ids, and the chunks of a node run through one SHA-256, which can't be split; no list of ids is ever held.

A family has ``family`` conversations at most; one very long conversation is one path, and its task holds a digest, a
number and an id of each of its turns. The base gives three turns at most, however long it is.

Defined cases: turns are ordered by turn, null first, and those of equal turn by their digest (of role and text). Null
roles and texts are empty. Rows without a conv_id are no conversation and are left out. Repeated rows are repeated turns.
An empty table gives an empty result (no conversation, so no root); other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import n_words, prepare, stage

FAMILY, CHUNK = 20, 4096
ROOT = hashlib.sha256(b"").digest()[:16]
NODES = "fam long, node binary, parent binary, depth long, conv_id long, n_convs long, words long, ends array<long>"
_NODE_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
SUMS = "node binary, saved_tokens long, n_leaves long"


def base_turns(conv_id: int) -> int:
    """How many turns of the base begin a conversation."""
    return zlib.crc32(str(conv_id).encode()) % 4


def rebuilt(turns: pa.Table, fam: int) -> Iterator[tuple[int, list[tuple[bytes, int]]]]:
    """(conv_id, its rebuilt turns as digest and words) of each conversation of a family, ids ascending."""
    own: dict[int, list] = defaultdict(list)
    columns = [turns[c].to_pylist() for c in ("conv_id", "turn", "digest", "words")]
    for c, turn, digest, words in zip(*columns, strict=True):
        own[c].append((turn is not None, turn or 0, digest, words))
    for x in own.values():
        x.sort()
    for c in sorted(own):
        h = base_turns(c)
        yield c, [x[2:] for x in own[fam][:h] + own[c][h:]] if fam in own else [x[2:] for x in own[c][h:]]


def family_trie(turns: pa.Table) -> pa.Table:
    """The nodes of one family's trie (``NODES``), with the conversations that end at each."""
    fam = turns["fam"][0].as_py()
    nodes: dict[bytes, list] = {}
    for c, path in rebuilt(turns, fam):
        node, parent, words = ROOT, None, 0
        for depth in range(len(path) + 1):
            if depth:
                parent, (digest, words) = node, path[depth - 1]
                node = hashlib.sha256(parent + digest).digest()[:16]
            if node in nodes:
                nodes[node][5] += 1
            else:
                nodes[node] = [fam, node, parent, depth, c, 1, words, []]
        nodes[node][7].append(c)
    columns = zip(*nodes.values(), strict=True)
    return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(columns, _NODE_TYPES, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def family_sums(nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """``SUMS`` of a family's nodes over those merged nodes below them that are the family's to add up."""
    value = {n: [v, int(leaf)] for n, v, leaf in zip(*(owned[c].to_pylist() for c in ("node", "value", "leaf")), strict=True)}
    order = sorted(zip(*(nodes[c].to_pylist() for c in ("depth", "node", "parent")), strict=True), key=lambda x: -x[0])
    sums = {node: value.get(node, [0, 0]) for _, node, _ in order}
    for _, node, parent in order:
        if parent is not None:
            sums[parent][0] += sums[node][0]
            sums[parent][1] += sums[node][1]
    rows = [(n, *x) for n, x in sums.items() if x[0] or x[1]]
    return pa.table({"node": pa.array([r[0] for r in rows], pa.binary()), "saved_tokens": pa.array([r[1] for r in rows], pa.int64()), "n_leaves": pa.array([r[2] for r in rows], pa.int64())})


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """(node, first, ids): sorted rows (node, conv_id) as chunks of ids joined by commas."""
    node, ids = None, []

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["node", "first", "ids"])

    for batch in batches:
        rows = []
        for n, c in zip(batch["node"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if ids and (n != node or len(ids) == chunk):
                rows.append((node, ids[0], b",".join(b"%d" % i for i in ids)))
                ids = []
            node = n
            ids.append(c)
        if rows:
            yield made(rows)
    if ids:
        yield made([(node, ids[0], b",".join(b"%d" % i for i in ids))])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of chunks sorted by node and first id."""
    node, state = None, None

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        rows = []
        for n, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if state:
                    rows.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(ids)
        if rows:
            yield made(rows)
    if state:
        yield made([(node, state.hexdigest())])


def ends_hashes(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): hex SHA-256 of each node's ids, ascending, joined by commas."""
    ranged = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = ranged.mapInArrow(partial(_chunks, chunk=chunk), "node binary, first long, ids binary")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    prepare(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    c = F.col("conv_id").cast("long")
    turns = conversations.where(c.isNotNull()).select(
        c.alias("conv_id"), (c - c % family).alias("fam"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), n_words(text).alias("words")
    )
    families = stage(turns.groupBy("fam").applyInArrow(family_trie, NODES), "families")

    merged = families.groupBy("node", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    merged = stage(merged, "merged")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stage(merged.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")

    owned = nodes.select(
        (F.col("conv_id") - F.col("conv_id") % family).alias("fam"), "node",
        ((F.col("n_convs") - 1) * F.col("words")).alias("value"), (F.col("n_children") == 0).alias("leaf"),
    )
    paths = families.select("fam", "node", "parent", "depth")
    sums = paths.groupBy("fam").cogroup(owned.groupBy("fam")).applyInArrow(family_sums, SUMS)
    sums = sums.groupBy("node").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = ends_hashes(families.select("node", F.explode("ends").alias("conv_id")))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node", "left").join(ends, "node", "left").join(above, "parent", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
