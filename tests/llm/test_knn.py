"""Exact search against all inner products."""

from __future__ import annotations

import math
import random

import pytest

from barloom.llm import knn as K


def brute_force(rows, asked, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {i: v for i, v in good if asked(i)}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def search(spark, rows, k=10):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id bigint, embedding array<float>, score string")
    vectors = K.quantised(df)
    return {tuple(r) for r in K.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k).collect()}


@pytest.mark.parametrize("cells", [(4096, 2000, 20_000), (40, 4, 30)])
def test_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(K, "CELL_ROWS", cells[0])
    monkeypatch.setattr(K, "QUERY_ROWS", cells[1])
    monkeypatch.setattr(K, "SLICE_ROWS", cells[2])
    monkeypatch.setattr(K, "BOUND_SAMPLE", 50)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(8)]
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [f32(c + rng.gauss(0, 0.3)) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)]  # one common vector: ties
    rows += [(1000, None), (1020, [1.0, None] * 3), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, rows[0][1]), (1080, [1.0, 2.0]), (1081, [2.0, 2.0])]
    assert search(spark, rows) == brute_force(rows, lambda i: i % 20 == 0, 10)


def test_few_or_no_vectors(spark):
    assert search(spark, []) == set()
    assert search(spark, [(0, [1.0])]) == set()
    assert search(spark, [(0, [1.0]), (1, [-0.5])]) == {(0, 1, 1, -524288)}


def test_large_numbers(spark):
    rows = [(0, [2.0**18, 3.0]), (1, [2.0**18, 2.0]), (2, [2.0**18, 2.5])]
    assert search(spark, rows) == brute_force(rows, lambda i: i == 0, 10)
