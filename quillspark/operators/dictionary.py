"""Dictionary matching (J14, X1): names of a dictionary of any size in whole texts, by Aho-Corasick automata.

The dictionary is dealt into shards of bounded size. A shard's automaton is built once in each task that reads with it,
and finds all its names in one pass over a text, whatever their number. A name counts where it stands as whole words.
Of overlapping names the leftmost counts, and of those that begin together the longest; that is settled for a text over
all shards, so a text's result doesn't depend on how the dictionary is dealt.

An automaton's steps are tokens: a whole run of word characters, or one other character. A name that matches so stands as
whole words, and a text costs a step for each of its tokens, not for each character.

Letters are compared without case, one to one (characters that lower case makes longer stay). Offsets are code points.

Defined cases: null and empty texts have no names; null and empty names are left out; of one name in several cases or
with several labels, the smallest (name, label) counts. Names may begin or end with any character; whole words then
means that no word character stands beside a word character of the name. Each row is a text, repeated ones too, but with a
dictionary of several shards rows of one id and text are one. Very long texts are one pass and one list of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shipping import ship
from quillspark.staging import stage

#: Bytes of names of a shard at most (an automaton has some 300 bytes of memory for each, less what names share).
SHARD_BYTES = 1 << 20
#: Names that a task gathers, about, before it passes them on.
HELD = 20_000


@lru_cache(maxsize=1 << 16)
def _low(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def folded(text: str) -> str:
    """text in lower case, as long as it was."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(map(_low, text))


#: Word characters are those of str.isalnum, and _.
TOKEN = re.compile(r"\w+|\W")


class Automaton:
    """The goto, failure and output links of a shard's names, over tokens."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.out: list[int] = [-1]  # the name that ends at a node
        self.names = names
        for i, (name, _) in enumerate(names):
            node = 0
            for c in TOKEN.findall(name):
                node = self.go[node].setdefault(c, len(self.go))
                if node == len(self.go):
                    self.go.append({})
                    self.out.append(-1)
            if self.out[node] < 0:
                self.out[node] = i
        self.fail, self.shorter = [0] * len(self.go), [0] * len(self.go)
        level = list(self.go[0].values())
        while level:
            below = []
            for node in level:
                for c, child in self.go[node].items():
                    f = self.fail[node]
                    while f and c not in self.go[f]:
                        f = self.fail[f]
                    self.fail[child] = self.go[f].get(c, 0)
                    below.append(child)
            for node in level:  # the nearest suffix that is a name
                f = self.fail[node]
                self.shorter[node] = f if self.out[f] >= 0 else self.shorter[f]
            level = below

    def spans(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, label) of every name that stands as whole words."""
        said = TOKEN.findall(text)
        ends = list(accumulate(map(len, said)))
        node, go, fail, root = 0, self.go, self.fail, self.go[0]
        for at, t in enumerate(said):
            if not node:
                node = root.get(t, 0)
                if not node:
                    continue
            else:
                while node and t not in go[node]:
                    node = fail[node]
                node = go[node].get(t, 0)
            hit = node if self.out[node] >= 0 else self.shorter[node]
            while hit:
                name, label = self.names[self.out[hit]]
                yield ends[at] - len(name), ends[at], label
                hit = self.shorter[hit]


def _shards(names: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The folded names in runs of at most ``most`` bytes, one after another."""
    fold = F.pandas_udf(lambda x: x.map(folded), "string")
    one = names.where("name <> ''").select(fold("name").alias("name"), F.coalesce("label", F.lit("")).alias("label"))
    held, n = [], 0
    for r in one.groupBy("name").agg(F.min("label").alias("label")).toLocalIterator():
        size = len(r.name.encode())
        if held and n + size > most:
            yield held
            held, n = [], 0
        held.append((r.name, r.label))
        n += size
    if held:
        yield held


def _settled(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    upto = 0
    for start, end, _ in spans:
        if start < upto:
            break
        upto = end
    else:  # in order, and none overlaps another
        return spans
    out, upto = [], 0
    for span in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if span[0] >= upto:
            out.append(span)
            upto = span[1]
    return out


def dictionary_spans(docs: DataFrame, names: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start, end, name, label) of the names (name, label) in docs (doc_id, text), name as the text has it."""
    spark = docs.sparkSession
    ship(spark)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    shards = _shards(names, shard_bytes)
    first, second = next(shards, None), next(shards, None)
    several = second is not None

    def found(shard: list[tuple[str, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(shard)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            for batch in batches:
                ids, hashes, held = batch.column(0), batch.column(2), []
                rows: list[int] = []

                def made(held: list, rows: list[int], ids=ids, hashes=hashes) -> pa.RecordBatch:
                    start, end, label, name = zip(*held, strict=True)
                    at = pa.array(rows, pa.int32())
                    return pa.RecordBatch.from_arrays(
                        [ids.take(at), hashes.take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string()), pa.array(label, pa.string())],
                        names=["doc_id", "hash", "start", "end", "name", "label"],
                    )

                for i in range(batch.num_rows):
                    text = batch.column(1)[i].as_py()
                    got = list(automaton.spans(folded(text))) if text else []
                    got = got if several else _settled(got)
                    held += [(a, b, x, text[a:b]) for a, b, x in got]
                    rows += [i] * len(got)
                    if len(held) >= HELD:
                        yield made(held, rows)
                        held, rows = [], []
                if held:
                    yield made(held, rows)

        text = F.col("text").cast("string")
        rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"))
        out = rows.mapInArrow(each, f"doc_id {id_kind}, hash long, start int, end int, name string, label string")
        if several:  # a shard's spans are kept before its names leave the executors
            out = stage(out, "spans")
            shared.destroy()
        return out

    columns = ["doc_id", "start", "end", "name", "label"]
    if first is None:
        return spark.createDataFrame([], f"doc_id {id_kind}, start int, end int, name string, label string")
    if not several:
        return found(first).select(*columns)
    parts = found(first).union(found(second))
    for shard in shards:
        parts = parts.union(found(shard))
    lists = parts.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("start", "end", "label", "name")).alias("all"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, all_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                said = {(x["start"], x["end"]): x["name"] for x in all_}
                kept = _settled([(x["start"], x["end"], x["label"]) for x in all_])
                ids += [i] * len(kept)
                rows += [(start, end, said[start, end], label) for start, end, label in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]],
                names=columns,
            )

    return lists.select("doc_id", "all").mapInArrow(settle, f"doc_id {id_kind}, start int, end int, name string, label string")
