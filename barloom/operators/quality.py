"""Checks on bars and signal files. Each returns a table; strict variants raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.bars import PRICE_COLUMNS

# Signal actions that may become orders.
ORDER_ACTIONS = ["buy", "sell", "hold"]


def bar_violations(bars: DataFrame) -> DataFrame:
    """Per symbol: duplicate dates, missing values and bars whose high is below the low.

    Rows are first counted per (symbol, date), so the work for one big symbol
    is spread over its dates before the symbol totals are formed.
    """
    missing = [c for c in ["symbol", "date", *PRICE_COLUMNS] if c not in bars.columns]
    if missing:
        raise ValueError(f"bars are missing columns {missing}")
    null_value = F.lit(False)
    for c in PRICE_COLUMNS:
        null_value = null_value | F.col(c).isNull() | F.isnan(c)
    per_day = bars.groupBy("symbol", "date").agg(
        F.count("*").alias("n"),
        F.count_if(null_value).alias("nulls"),
        F.count_if(F.col("high") < F.col("low")).alias("crossed"),
    )
    return per_day.groupBy("symbol").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("duplicate_dates"),
        F.sum("nulls").alias("null_rows"),
        F.sum("crossed").alias("high_below_low"),
    )


def validate_bars(bars: DataFrame) -> DataFrame:
    """Return ``bars`` unchanged, or raise naming the first broken rule."""
    broken = (
        bar_violations(bars)
        .filter("duplicate_dates > 0 or null_rows > 0 or high_below_low > 0")
        .orderBy("symbol")
        .limit(1)
        .collect()
    )
    if broken:
        row = broken[0]
        rule = next(k for k in ("duplicate_dates", "null_rows", "high_below_low") if row[k] > 0)
        raise ValueError(f"{row['symbol']}: {rule} in {row[rule]} row(s)")
    return bars


def broken_symbols(bars: DataFrame) -> DataFrame:
    """``(symbol, reason, n)``: each rule that a symbol breaks, with the rows that break it."""
    rules = ("duplicate_dates", "null_rows", "high_below_low")
    counted = bar_violations(bars).select("symbol", F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in rules])).alias("rule"))
    return counted.select("symbol", "rule.reason", "rule.n").filter("n > 0")


def sound_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bars of the symbols that break no rule, and the others with their reasons.

    For a scan of many symbols, of which a few broken ones must not stop the rest.
    """
    reasons = broken_symbols(bars)
    return bars.join(reasons.select("symbol").distinct(), "symbol", "left_anti"), reasons


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Return ``df``, or raise when it is empty (looks at one row only).

    For results that must not be empty, such as a backtest whose predictions
    and closes share no date.
    """
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def signal_file_check(signals: DataFrame, file_col: str = "file") -> DataFrame:
    """Per file: number of distinct dates and whether the file may be executed."""
    if "date" not in signals.columns:
        raise ValueError("a signal file needs a 'date' column")
    return signals.groupBy(file_col).agg(
        F.countDistinct("date").alias("n_dates"),
        (F.countDistinct("date") <= 1).alias("is_valid"),
    )


def executable_actions(signals: DataFrame) -> DataFrame:
    """Rows that may become orders: cleaned action in buy, sell or hold, missing score 0."""
    return (
        signals.withColumn("action", F.lower(F.trim("action")))
        .filter(F.col("action").isin(ORDER_ACTIONS))
        .withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
        .withColumn("reason", F.coalesce(F.col("reason"), F.lit("")))
    )
