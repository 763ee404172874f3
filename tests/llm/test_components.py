from __future__ import annotations

import random

from barloom.llm.components import Forest, connected_components


def test_components_of_chains_stars_and_random_links(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    rng.shuffle(edges)
    forest = Forest()
    for a, b in edges:
        if a != b:
            forest.union(a, b)
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "a bigint, b bigint").repartition(7)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {x: forest.find(x) for x in list(forest.parent)}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a binary, b binary")).collect() == []
