"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(num, den)


def change(new: Column, old: Column) -> Column:
    """Relative change ``new/old - 1``."""
    return F.try_divide(new, old) - F.lit(1.0)


def no_nan(col: Column) -> Column:
    """NaN becomes NULL: results never store NaN."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def full_window(agg: Callable[[Column], Column], col: Column, w: WindowSpec, n: int) -> Column:
    """``agg`` over the last ``n`` rows, NULL unless all ``n`` values are present."""
    frame = trailing(w, n)
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))


def utc_date(text: Column) -> Column:
    """UTC calendar day of a date or timestamp string, whatever the session zone.

    Strings without an offset are read as UTC; an explicit offset is honoured.
    """
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d{2}:\d{2}")
    instant = F.try_to_timestamp(text)
    shifted = F.to_utc_timestamp(instant, F.current_timezone())
    return F.to_date(F.when(has_offset, shifted).otherwise(instant))


def literals(rows: list[dict], types: dict[str, str]) -> Column:
    """A constant array of structs, for fanning rows out over a fixed parameter list."""
    return F.array(
        *[F.struct(*[F.lit(r[k]).cast(t).alias(k) for k, t in types.items()]) for r in rows]
    )


def fan_out(df, rows: list[dict], types: dict[str, str]):
    """One copy of every row per parameter set; the list is given by the caller, not by data."""
    tmp = "_param"
    out = df.withColumn(tmp, F.explode(literals(rows, types)))
    return out.select(*df.columns, *[F.col(f"{tmp}.{k}").alias(k) for k in types])
