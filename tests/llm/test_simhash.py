"""SimHash fingerprints and groups against plain Python."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from barloom.llm import simhash as S
from barloom.llm.components import connected_components
from tests.llm.conftest import prose


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    parts = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(fps, distance=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(fps)):
        for i in range(j):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    for text in [None, "", " \n\t\x0b\x0c ", "One", "one Two three", "a b c d", "É é A b c d e f", *[prose(rng, n) for n in (5, 50, 400)]]:
        assert S.fingerprint(text) == plain_fingerprint(text)


def test_links_connect_exactly_the_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_SIZE", 40)
    monkeypatch.setattr(S, "LEAF", 16)
    rng = random.Random(2)
    fps = {0, 1, 2**63, 2**64 - 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    got = {r.node: r.root for r in connected_components(S.links(df)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    want = plain_groups(fps)
    mine = [got.get(s, s) for s in signed]
    assert len({*zip(want, mine)}) == len(set(want)) == len(set(mine))


def test_documents(documents):
    rng = random.Random(4)
    text = prose(rng, 300)
    words = text.split()
    near = " ".join([*words[:150], "zebra", *words[151:]])
    rows = [(5, text), (3, near), (9, text), (7, prose(rng, 200)), (8, None), (2, ""), (None, text), (7, "other words here now"), (7, "other words here now")]
    groups = S.near_duplicates(documents(rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_groups(fps)
    want = sorted((i is None, i or 0, min((rows[j][0] for j in range(len(rows)) if root[j] == root[n] and rows[j][0] is not None))) for n, (i, _) in enumerate(rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in groups) == want
    df = documents(rows)
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, near), (7, rows[3][1]), (2, ""), (7, "other words here now")])
    assert S.deduplicate(documents([])).collect() == [] == S.near_duplicates(documents([])).collect()


def test_shingle_hashes_in_bulk():
    rng = random.Random(11)
    data = rng.randbytes(3000)
    sizes = np.array([rng.choice([0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 45, 64, 70, 255, 256, 257, 400, rng.randrange(500)]) for _ in range(3000)])
    starts = np.array([rng.randrange(3001 - n) for n in sizes.tolist()])
    want = [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(starts.tolist(), sizes.tolist())]
    assert S.xxh64(data, starts, sizes).tolist() == want


def test_texts_are_hashed_together_across_pieces(monkeypatch):
    rng = random.Random(12)
    texts = ["", "a", *[prose(rng, rng.randrange(1, 900)) for _ in range(20)], None, "b c"]
    monkeypatch.setattr(S, "HASHED", 37)
    assert S._fingerprints(texts).tolist() == [plain_fingerprint(t) for t in texts]


def _near_copies(rng, groups, copies):
    fps = set()
    for _ in range(groups):
        f = rng.getrandbits(64)
        for _ in range(copies):
            g = f
            for _ in range(rng.randrange(5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    return np.array(sorted(fps), np.uint64)


def test_few_rows_are_dealt_and_every_close_pair_meets():
    fps = _near_copies(random.Random(13), 20_000, 1)
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:1500, None] ^ fps[None, :1500]) <= 20, 1))
    dealt = 0
    for mask in S.blocks_of(4):
        tree = S.Tree(mask, 1)
        tree.grow(fps, 400, np.random.default_rng(7))
        rows, shards = tree.route(fps)
        dealt += len(rows)
        close = np.bitwise_count((fps[a] ^ fps[b]) & np.uint64(mask)) <= 1
        together = {}
        for row, shard in zip(rows.tolist(), shards.tolist()):
            together.setdefault(row, set()).add(shard)
        assert close.any() and all(together[i] & together[j] for i, j in zip(a[close].tolist(), b[close].tolist()))
    # 16.4 rows of each fingerprint when points went over a cut both ways, with 64 shards of up to 2567 rows
    assert dealt < 10 * len(fps)


def test_links_of_near_copies_are_few(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_SIZE", 40)
    fps = _near_copies(random.Random(14), 60, 30)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    links = S.links(df)
    # 5.2 a fingerprint when each shard spanned its components anew
    assert links.count() < 4 * len(fps)
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = plain_groups([int(f) for f in fps])
    mine = [got.get(int(f), int(f)) for f in fps.view(np.int64)]
    assert len({*zip(want, mine)}) == len(set(want)) == len(set(mine))


def test_local_components_of_large_groups_and_wide_radius(monkeypatch):
    rng = random.Random(15)
    hot = rng.getrandbits(64)
    near = {hot ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(8))}) for _ in range(900)}
    fps = np.array(sorted(near | {rng.getrandbits(64) for _ in range(300)}), np.uint64)
    for distance, group, flips in [(4, 64, 300), (4, 8, 300), (0, 8, 300), (7, 64, 300), (13, 64, 300), (4, 64, 0)]:
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "MAX_FLIPS", flips)
        monkeypatch.setattr(S, "LEAF", 16)
        monkeypatch.setattr(S, "MAX_PAIRS", 999)
        masks = S.blocks_of(distance)
        root = np.arange(len(fps))
        for mask in masks:
            order = np.argsort(fps & np.uint64(mask))
            S._join(root, order, order[S.local_components(fps[order], mask, distance // len(masks), distance, np.random.default_rng(7))])
        assert root.tolist() == plain_groups(fps.tolist(), distance)
