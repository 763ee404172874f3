"""Exact top-k search by inner product: a Voronoi join of queries and data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.batches import bounded_sample, input_columns
from barloom.session import kept

SCALE = 1024
#: Data vectors aimed at in a cell, and pivots at most.
CELL_ROWS, MAX_PIVOTS = 4096, 1024
#: Queries solved together, and data rows they meet in one task; larger groups and cells are cut up.
QUERY_ROWS, SLICE_ROWS = 2000, 20_000
#: Vectors of the sample from which each query takes a first bound.
BOUND_SAMPLE = 4096


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` with whole-number components; vectors that are null or not finite throughout go, as do null ids."""
    rows = input_columns(vectors, vec_id=vec_id, e=embedding).filter("vec_id IS NOT NULL AND e IS NOT NULL")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.filter(fine).select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = pa.compute.list_value_length(column).to_numpy()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), int(lengths[0]) if len(lengths) else 0)


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles hold them while no sum can pass 2**53, else whole numbers are used."""
    bound = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries @ data.T).astype(np.int64)
    if bound < 2**62:
        return queries.astype(np.int64) @ data.astype(np.int64).T
    whole = [[int(x) for x in row] for row in data]
    made = [[sum(int(a) * b for a, b in zip(q, row)) for row in whole] for q in queries]
    return np.clip(np.array(made, object).reshape(len(queries), len(data)), -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each row, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    by = np.argsort(-score[:, order].astype(object) if score.size and score.min() == -(2**63) else -score[:, order], axis=1, kind="stable")[:, :k]
    return order[by]


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest pivot of each point and a distance that is no less than the true one."""
    squares = (pivots * pivots).sum(1)[None, :] - 2 * points @ pivots.T
    cell = squares.argmin(1)
    return cell, np.sqrt(((points - pivots[cell]) ** 2).sum(1)) * (1 + 1e-9)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all other vectors for each query.

    Both tables come from :func:`quantised`. Scores are inner products, ties go
    to the smaller vec_id, and rows with the query's own id are no candidates.
    Only vectors of equal length are compared, and scores beyond a long are
    clipped to its ends. A query id that repeats counts
    once; other repeated rows are candidates each on their own; empty tables
    give no rows.
    """
    vectors = kept(vectors, "vectors")
    parts = [_top_k(vectors.filter(F.size("v") == r.n), queries.filter(F.size("v") == r.n), k, r["count"]) for r in vectors.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    if not parts:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score bigint")
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top_k(data: DataFrame, queries: DataFrame, k: int, n: int) -> DataFrame:
    kind = data.schema["vec_id"].dataType.simpleString()
    n_pivots = min(MAX_PIVOTS, max(1, math.ceil(n / CELL_ROWS)))
    sample = bounded_sample(data, max(BOUND_SAMPLE, n_pivots), "vec_id").collect()
    sample_ids = np.array([r.vec_id for r in sample])
    sample_v = np.array([r.v for r in sample], np.float64).reshape(len(sample), -1)
    pivots = np.unique(sample_v[:n_pivots], axis=0)

    # summaries of the cells: how many vectors, and how far the farthest lies from the pivot
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = _nearest(_matrix(batch.column(1)), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], names=["vec_id", "v", "cell", "distance"])

    celled = data.mapInArrow(assign, f"vec_id {kind}, v array<bigint>, cell bigint, distance double")
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in celled.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("size")).collect():
        radius[r.cell], size[r.cell] = r.radius, r["size"]
    slices = np.maximum(1, -(-size // SLICE_ROWS))

    # groups of queries around pivots of their own, and the cells that may hold a result of each
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = asked.count()
    n_groups = min(MAX_PIVOTS, max(1, n_queries // QUERY_ROWS))
    centres = np.unique(sample_v[:n_groups], axis=0)
    blocks = max(1, math.ceil(n_queries / (len(centres) * QUERY_ROWS)))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, q = np.array(batch.column(0).to_pylist()), _matrix(batch.column(1))
            own, _ = _nearest(q, centres)
            own = own * blocks + np.abs(ids) % blocks
            known = scores(q, sample_v).astype(np.float64)
            known[ids[:, None] == sample_ids[None, :]] = -np.inf
            floor = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(q), -np.inf)
            reach = q @ pivots.T + np.sqrt((q * q).sum(1))[:, None] * radius[None, :]
            needed = reach + 1e-6 * np.abs(reach) + 1e-6 >= floor[:, None]
            cells = [np.flatnonzero(row).tolist() for row in needed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(cells, pa.list_(pa.int64()))], names=["query_id", "q", "grp", "cells"])

    grouped = kept(asked.mapInArrow(group, f"query_id {kind}, q array<bigint>, grp bigint, cells array<bigint>"), "queries")
    pairs = kept(grouped.select("grp", F.explode("cells").alias("cell")).distinct().groupBy("cell").agg(F.sort_array(F.collect_set("grp")).alias("grps")), "pairs")
    spread = F.element_at(F.lit(slices.tolist()), (F.col("cell") + 1).cast("int"))
    placed = celled.join(pairs, "cell").select(F.explode("grps").alias("grp"), "cell", F.pmod(F.xxhash64("vec_id", "v"), spread).alias("slice"), "vec_id", "v")
    sent = grouped.select("query_id", "q", "grp", F.explode("cells").alias("cell")).select("query_id", "q", "grp", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), (spread - 1).cast("bigint"))).alias("slice"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [left.schema.field("query_id").type, right.schema.field("vec_id").type, pa.int64()]
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids, v = right.column("vec_id").combine_chunks(), _matrix(right.column("v").combine_chunks())
            asked, q = left.column("query_id").combine_chunks(), _matrix(left.column("q").combine_chunks())
            numbers, asking = np.array(ids.to_pylist()), np.array(asked.to_pylist())
            for at in range(0, len(q), 256):
                score = scores(q[at : at + 256], v)
                places = best(score, numbers, k + int((numbers[:, None] == asking[None, at : at + 256]).sum(0).max()))
                row = np.repeat(np.arange(len(score)), places.shape[1])
                place = places.ravel()
                other = numbers[place] != asking[at + row]
                out[0] += asking[at + row[other]].tolist()
                out[1] += numbers[place[other]].tolist()
                out[2] += score[row[other], place[other]].tolist()
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    keys = ["grp", "cell", "slice"]
    return sent.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(solve, f"query_id {kind}, vec_id {kind}, score bigint")
