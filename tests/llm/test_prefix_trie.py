from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, turns int, k0 string"


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)

    return make


def plain(rows, lead=True):
    """The nodes by their definition, one path at a time."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if lead else 0
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:]) if h else tuple(turns)
    members = defaultdict(list)
    for c, w in built.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, who in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for e in range(len(p) + 1):
            leaves[p[:e]] += not children[p]
            saved[p[:e]] += (len(who) - 1) * words
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if built[c] == p)
        above = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), above, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n, turns=6, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(turns)):
            rows.append((c, t if t or rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "a  b"][:words])))
    return rows


@pytest.mark.parametrize("shard_turns", [5, 40, 100_000])
def test_nodes_are_those_of_the_definition_whatever_the_shards(table, shard_turns):
    rows = made(3, 120)
    lists = pt.with_shared_lead(pt.turn_lists(table(rows)))
    assert nodes(pt.prefix_trie(lists, shard_turns)) == plain(rows)


def test_hot_copies_and_prefixes_across_shards(table):
    rows = [(c, t, "user", "same text") for c in range(0, 80) for t in range(4)]
    rows += [(100 + c, t, "user", "same text") for c in range(30) for t in range(c % 9)]
    rows += [(200 + c, t, "user", f"w{c % 3} {t}") for c in range(30) for t in range(12)]
    assert nodes(pt.prefix_trie(pt.turn_lists(table(rows)), 3)) == plain(rows, lead=False)


def test_empty_null_and_repeated_rows(table, spark):
    assert pt.prefix_trie(pt.with_shared_lead(pt.turn_lists(table([])))).count() == 0
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 2, "user", "é x y"), (7, 2, "user", "é x y"), (8, 1, "", "")]
    assert nodes(pt.prefix_trie(pt.turn_lists(table(rows)))) == plain(rows, lead=False)
    # no turns at all: the conversation ends at the root
    bare = spark.createDataFrame([(5, []), (3, [])], "conv bigint, turns array<struct<key: binary, words: bigint>>")
    digest = hashlib.sha256(b"3,5").hexdigest()
    assert nodes(pt.prefix_trie(bare)) == [(3, 0, None, 2, 0, 1, 0, digest)]


def test_one_very_long_conversation(table):
    rows = [(1, t, "user", f"w {t}") for t in range(3000)] + [(2, t, "user", f"w {t}") for t in range(2500)] + [(3, 0, "user", "else")]
    found = nodes(pt.prefix_trie(pt.turn_lists(table(rows)), 500))
    assert len(found) == 3002
    root = next(r for r in found if r[1] == 0)
    assert root[3:7] == (3, 2, 2, 2 * 2500)


def test_many_members_of_one_sequence(table, spark):
    lists = spark.range(10_000).select(F.col("id").alias("conv"), F.array(F.struct(F.lit(bytes(16)).alias("key"), F.lit(2).cast("bigint").alias("words"))).alias("turns"))
    found = nodes(pt.prefix_trie(lists))
    ends = hashlib.sha256(",".join(map(str, range(10_000))).encode()).hexdigest()
    assert [r[7] for r in found if r[1] == 1] == [ends]
    assert [r[6] for r in found] == [2 * 9999] * 2


@pytest.mark.parametrize("seed", range(4))
def test_findclose_against_a_stack(seed):
    rng = random.Random(seed)
    bits, depth = [True], 1
    while depth:
        up = rng.random() < 0.5 if len(bits) < 30_000 else False
        if depth == 1 and len(bits) < 20_000:
            up = True
        bits.append(up)
        depth += 1 if up else -1
    tree = pt.Parentheses(np.array(bits))
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    at = np.flatnonzero(tree.opens)
    assert tree.findclose(at).tolist() == [want[i] for i in at.tolist()]
