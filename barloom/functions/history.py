"""Windows along one symbol's history, safe for long histories.

Two grains of time column are supported:

* ``DATE``: at most one row per key and day, so a key has at most ~366 rows a
  year and a century fits one task easily. One shuffle and one sort by key
  serve every window of an operator.
* ``TIMESTAMP``: intraday rows have no such bound. Histories are cut into
  blocks of ``block_rows`` consecutive rows; rows near a cut are copied to the
  neighbouring block (the halo), windows run per block, copies are dropped.
  Running totals and last known values are two-level scans: inside a day, plus
  those of the days before. A symbol holding most of the table is then spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 65_536

Stage = Callable[[WindowSpec], dict[str, Column]]

_SCANS = {
    "sum": F.sum,
    "product": F.product,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def calendar_bounded(df: DataFrame, order: str = "date") -> bool:
    """True when the time column is a DATE, which bounds the rows per key."""
    return isinstance(df.schema[order].dataType, T.DateType)


def over_history(
    df: DataFrame,
    *stages: Stage,
    keys: Sequence[str] = ("symbol",),
    order: str = "date",
    back: int = 0,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the window columns of each stage, one stage after the other.

    ``back`` and ``ahead`` say how many rows before and after a row all stages
    together look at; they size the halo for intraday histories.
    """
    if calendar_bounded(df, order):
        w = Window.partitionBy(*keys).orderBy(order)
        for stage in stages:
            df = df.withColumns(stage(w))
        return df
    if max(back, ahead) > block_rows:
        raise ValueError("block_rows must be at least as long as the window")

    placed = position(df, keys=keys, order=order, out="_pos")
    within = F.col("_pos") % block_rows
    copies = F.array_compact(
        F.array(
            F.lit(0),
            F.when(within >= block_rows - back, F.lit(1)),
            F.when(within < ahead, F.lit(-1)),
        )
    )
    spread = placed.withColumn("_copy", F.explode(copies)).withColumn(
        "_block", F.floor(F.col("_pos") / block_rows) + F.col("_copy")
    )
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    for stage in stages:
        spread = spread.withColumns(stage(w))
    return spread.filter(F.col("_copy") == 0).drop("_pos", "_copy", "_block")


def running(
    df: DataFrame,
    outs: dict[str, tuple[str, str]],
    *,
    keys: Sequence[str] = ("symbol",),
    order: str | Sequence[str] = "date",
    block: str | None = None,
    backwards: bool = False,
) -> DataFrame:
    """Running ``sum``, ``product``, ``max`` or ``last`` known value from the start of each key.

    ``outs`` maps an output name to ``(kind, input column)``. With one row per
    key and DATE a single window does it. Otherwise the scan has two levels:
    inside a ``block`` (by default the day of the time column; it must follow
    the order), plus the totals of the blocks before. ``backwards`` scans from
    the end of each key, so that ``last`` is the next known value.
    """
    by = [order] if isinstance(order, str) else list(order)
    turn = [F.col(c).desc() if backwards else F.col(c).asc() for c in by]
    if block is None and calendar_bounded(df, by[0]):
        w = Window.partitionBy(*keys).orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({o: _SCANS[k](F.col(c)).over(w) for o, (k, c) in outs.items()})

    cut = df.withColumn("_cut", F.col(block) if block else F.to_date(by[0]))
    totals = cut.groupBy(*keys, "_cut").agg(
        *[_total(k, c, by, backwards).alias(f"_t_{o}") for o, (k, c) in outs.items()]
    )
    blocks = F.col("_cut").desc() if backwards else F.col("_cut").asc()
    before = Window.partitionBy(*keys).orderBy(blocks).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_cut",
        *[_SCANS[k](F.col(f"_t_{o}")).over(before).alias(f"_c_{o}") for o, (k, _) in outs.items()],
    )
    inside = Window.partitionBy(*keys, "_cut").orderBy(*turn).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, [*keys, "_cut"])
    both = {
        o: _combine(k, _SCANS[k](F.col(c)).over(inside), F.col(f"_c_{o}")) for o, (k, c) in outs.items()
    }
    return joined.withColumns(both).select(*df.columns, *outs)


def _total(kind: str, value: str, by: list[str], backwards: bool) -> Column:
    """Value of a whole block; groups have no order, so the last one is found by its place."""
    if kind != "last":
        return _SCANS[kind](F.col(value))
    place = F.when(F.col(value).isNotNull(), F.struct(*by))
    return F.min_by(value, place) if backwards else F.max_by(value, place)


def _combine(kind: str, here: Column, carry: Column) -> Column:
    """Value so far in the block joined with the blocks before; NULL means no value yet."""
    if kind == "max":
        return F.greatest(here, carry)
    if kind == "last":
        return F.coalesce(here, carry)
    joint = here + carry if kind == "sum" else here * carry
    return F.coalesce(joint, here, carry)


def position(
    df: DataFrame, *, keys: Sequence[str] = ("symbol",), order: str = "date", out: str = "pos"
) -> DataFrame:
    """0-based row number of each row in its key's history."""
    if calendar_bounded(df, order):
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn(out, F.row_number().over(w).cast("long") - 1)
    counted = running(df.withColumn("_one", F.lit(1)), {out: ("sum", "_one")}, keys=keys, order=order)
    return counted.drop("_one").withColumn(out, F.col(out) - 1)
