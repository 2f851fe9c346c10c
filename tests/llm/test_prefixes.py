"""The prefix trie of conversations, against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from flowspark.llm.prefixes import DoubleArray, end_digests, prefix_trie, shared_heads, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string"


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA).repartition(parts)
    got = prefix_trie(*shared_heads(turns_of(df)), **options).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_conversations(spark):
    """Nulls, gaps, absent parents, negative ids, repeated and empty turns, one conversation of a third of all turns, one first turn that many share."""
    rng = random.Random(4)
    say = ["", "hi", "é", "日本", "tell me", "x" * 300]
    rows = [(c, t if t else rng.choice([0, None]), rng.choice(["user", None, "a"]), rng.choice([*say, None])) for c in [*range(0, 40), *range(103, 109), -7, -5, -3] for t in range(rng.randint(1, 12))]
    rows += [(200 + c, t, "user", "start" if t < 3 else rng.choice(say)) for c in range(80) for t in range(rng.randint(3, 6))]
    rows += [(400, t, "user", rng.choice(say)) for t in range(400)] + [(401, t, "user", f"{t % 7}") for t in range(90)]
    rows += [(600, t, "user", "again") for t in range(20)] * 2  # turns with one number: equal rows
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    same(spark, rows, band=64, limit=4096)
    same(spark, rows, parts=5, band=4, limit=8)  # many bands, hot prefixes over many shards


def test_copies_and_turnless(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1120) for t in range(9)]  # all alike, in whole or in part
    rows += [(c, 0, "user", "only") for c in range(3001, 3005)]  # parent absent: turnless where the head takes all
    same(spark, rows, band=4, limit=16)


def test_empty(spark):
    assert prefix_trie(*shared_heads(turns_of(spark.createDataFrame([], SCHEMA)))).count() == 0
    assert prefix_trie(*shared_heads(turns_of(spark.createDataFrame([(None, 1, "a", "b", "", "")], SCHEMA)))).count() == 0


def test_digests_in_pieces(spark):
    """A node at which 150,000 conversations end, joined in pieces of ranges and batches."""
    ends = spark.range(150_000).selectExpr("1L as k1", "2L as k2", "3L as depth", "id * 7 as conv").union(spark.sql("select 1L, 3L, 3L, 5L"))
    got = {(r.k1, r.k2, r.depth): r.ends for r in end_digests(ends).collect()}
    ids = ",".join(str(7 * k) for k in range(150_000)).encode()
    assert got == {(1, 2, 3): hashlib.sha256(ids).hexdigest(), (1, 3, 3): hashlib.sha256(b"5").hexdigest()}


@pytest.mark.parametrize("seed", range(4))
def test_double_array(seed):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 8, 300)
    codes = rng.integers(1, [3, 50, 4, 2000, 5, 5, 9], (300, 7))
    trie, at, paths = DoubleArray(codes, size), np.zeros(300, np.int64), {}
    for j in range(7):
        live = np.flatnonzero(size > j)
        at[live] = trie.step(at[live], codes[live, j])
        for k in live.tolist():
            assert paths.setdefault(int(at[k]), tuple(codes[k, : j + 1])) == tuple(codes[k, : j + 1])
    assert len(paths) == len({tuple(codes[k, : j + 1]) for k in range(300) for j in range(size[k])}) and (trie.check >= 0).sum() == len(paths) + 1
    with pytest.raises(KeyError):
        trie.step(np.array([0]), np.array([1999]))
