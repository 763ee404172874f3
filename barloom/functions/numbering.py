"""Row numbers within groups that may be as large as the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import kept


def numbered(rows: DataFrame, keys: Sequence[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` with their number, from 1, in ``order`` within ``keys``, as a long.

    The rows are dealt by ranges of keys and order over the tasks; each range
    numbers its own rows, and the counts of the ranges before it are added. Only
    the counts meet in one window: a row for each range and group. The order
    must tell the rows of a group apart.
    """
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    # ranges are sampled anew each time a plan runs, so they are written down
    placed = kept(ranged, "ranges")
    own = Window.partitionBy("_range", *keys).orderBy(*order)
    counts = placed.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.withColumn("_own", F.row_number().over(own)).join(offsets, ["_range", *keys])
    return joined.withColumn(out, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
