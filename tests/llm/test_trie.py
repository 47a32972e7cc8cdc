"""The prefix trie against a plain one made of whole sequences; edges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from quillspark.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    path = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c in sorted(path):
        for d in range(len(path[c]) + 1):
            members[path[c][:d]].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        out.append((
            m[0], len(p), members[p[:-1]][0] if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(x) == len(q) + 1 and x[:-1] == q for x in below) for q in below),
            sum((len(members[q]) - 1) * words(q) for q in below), sha(",".join(str(c) for c in m if len(path[c]) == len(p))),
        ))
    return out


def check(spark, rows):
    got = [tuple(r) for r in T.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda x: x[:2]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def talk(seed, n, words=("a", "b c", "d  e\tf")):
    r = random.Random(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", r.choice(words)) for c in r.sample(range(-60, 3 * n), n) for t in range(r.randint(1, 6))]


def test_equals_a_plain_trie(spark):
    got = check(spark, talk(1, 130))
    assert max(x[3] for x in got) > 20 and max(x[4] for x in got) > 2
    check(spark, talk(2, 40, ("only",)))


def test_edges(spark):
    rows = [
        (5, None, "user", "first"), (5, 0, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (40, 2, "user", "x y"), (40, 1, "", ""),
        (41, 0, "user", "x y"), (60, 0, "user", "deep\nline"), (61, 9, "user", "own"), (None, 0, "user", "nobody"), (10**15 + 7, 0, "user", "x y"),
    ]
    check(spark, rows)
    got = {x[1]: x for x in check(spark, [(1, 0, "u", "w")])}  # its only turn is the base's, which there is none of
    assert T.base_turns(1) and list(got) == [0] and got[0][7] == sha("1")
    empty = spark.createDataFrame([], SCHEMA + ", node string, fam int")
    assert T.prefix_trie(empty).count() == 0


def test_one_very_long_conversation_and_many_alike(spark):
    rows = [(100, t, "user", f"w{t % 7}") for t in range(3000)] + [(c, t, "user", "same") for c in range(2000, 4000) for t in range(2)]
    got = T.prefix_trie(spark.createDataFrame(rows, SCHEMA).withColumn("depth", T.F.lit("x"))).collect()
    deep = max(got, key=lambda r: r.depth)
    assert deep.depth == 3000 and deep.conv_id == 100 and deep.n_leaves == 1
    hot = next(r for r in got if r.depth == 2 and r.conv_id >= 2000 and r.n_convs > 1000)
    assert hot.ends_sha256 == sha(",".join(str(c) for c in range(2000, 4000))) and hot.n_convs == 2000


def test_ids_are_hashed_in_chunks_of_any_size(spark):
    rows = [(b"a" if c % 3 else b"b", c) for c in range(500)] + [(b"c", 10**12)]
    want = {n: sha(",".join(str(c) for m, c in rows if m == n)) for n in (b"a", b"b", b"c")}
    ends = spark.createDataFrame(rows, "node binary, conv_id long").repartition(3)
    for chunk in (1, 7, 4096):
        assert {bytes(r.node): r.ends_sha256 for r in T.ends_hashes(ends, chunk).collect()} == want
