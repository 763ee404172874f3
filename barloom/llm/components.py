"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import lean
from barloom.session import kept


class Forest:
    """Union-find over whatever hashable ids; the smaller id becomes the root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


#: Edges a task contracts at a time.
FOREST_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the task's own edges, which connect the same nodes with fewer, shallower links."""
    forest, n, schema = Forest(), 0, None

    def stars():
        nodes = [x for x in forest.parent if forest.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, schema.field(0).type), pa.array([forest.find(x) for x in nodes], schema.field(1).type)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
            n += 1
        if n >= FOREST_EDGES:
            yield stars()
            forest, n = Forest(), 0
    if n:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: root is the smallest node it reaches.

    Each task first contracts its own edges by union-find. Then links are
    rewired round by round, every neighbour to the smallest one around its
    node (large stars, then small stars), until nothing changes; what a round
    gives is written to the shared folder, so plans stay short. No task holds
    the neighbours of a node: the smallest is an aggregate that is joined back.
    Null nodes and loops carry no link; an empty edge list gives no rows.
    """
    links = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .mapInArrow(lean(_contract), edges.select("a", "b").schema)
        .distinct()
    )
    links = kept(links, "links")
    while True:
        large = _rewired(links, large=True)
        links_next = kept(_rewired(large, large=False), "links")
        # stars are stable: every node hangs on one root and no root hangs on another
        changed = links_next.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or links_next.join(
            links_next.select(F.col("b").alias("root")).distinct(), F.col("a") == F.col("root"), "left_semi"
        ).limit(1).count()
        links = links_next
        if not changed:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _rewired(links: DataFrame, large: bool) -> DataFrame:
    """One step of star contraction over links ``(a, b)`` with ``a > b``."""
    around = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = around.join(smallest, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()
