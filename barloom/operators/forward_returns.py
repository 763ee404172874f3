"""What happened after past signals: forward returns and grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.exprs import change
from barloom.functions.history import over_history, running

# Horizons in trading days and the score buckets [low, high).
HORIZONS = (5, 20, 60)
SCORE_BUCKETS = ((0.00, 0.55, "<0.55"), (0.55, 0.60, "0.55-0.60"), (0.60, 0.65, "0.60-0.65"), (0.65, 1.01, ">0.65"))
NO_ACTION = "(no action)"


def entry_bars(signals: DataFrame, bars: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """First bar on or after each ``(symbol, date)`` asked for.

    Returns the distinct ``(symbol, date, entry_date, carry...)``; NULL past the
    last bar. Requests and bars are sorted together, newest first, and the last bar
    seen is kept, so there is no join on a date range. Distinct requests are at
    most one per symbol and time, however many signals ask; intraday histories
    are scanned day by day, with the first bar of the days after carried over.
    """
    payload = F.struct(F.col("date").alias("entry_date"), *[F.col(c) for c in carry])
    asked = signals.select("symbol", "date").filter("date is not null").distinct()
    timeline = bars.select("symbol", "date", payload.alias("_bar"), F.lit(1).alias("_kind")).unionByName(
        asked.withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    found = running(timeline, {"_next": ("last", "_bar")}, order=["date", "_kind"], backwards=True).filter("_kind = 0")
    return found.select(
        "symbol", "date", F.col("_next.entry_date").alias("entry_date"), *[F.col(f"_next.{c}").alias(c) for c in carry]
    )


def forward_name(h: int) -> str:
    return f"return_{h}d_forward"


def add_forward_returns(
    signals: DataFrame, bars: DataFrame, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """Append the return from the entry bar to the bar ``h`` rows later, per horizon.

    NULL when the symbol is unknown or the history ends too early.
    """
    names = [forward_name(h) for h in horizons]
    moved = over_history(
        bars.select("symbol", "date", "close"),
        lambda w: {forward_name(h): change(F.lead("close", h).over(w), F.col("close")) for h in horizons},
        ahead=max(horizons),
    )
    entries = entry_bars(signals, moved, names).select("symbol", "date", *names)
    return signals.join(entries, ["symbol", "date"], "left").select(*signals.columns, *names)


def summary_columns(horizons: Sequence[int] = HORIZONS) -> list[Column]:
    """Count, and per horizon valid count, mean and win rate."""
    out = [F.count(F.lit(1)).alias("n")]
    for h in horizons:
        r = F.col(forward_name(h))
        out += [
            F.count(r).alias(f"n_valid_{h}d"),
            F.avg(r).alias(f"avg_{h}d"),
            F.avg((r > 0).cast("double")).alias(f"win_{h}d"),
        ]
    return out


def summarise_group(rows: DataFrame, keys: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Forward-return summary per group; a NULL key is a group of its own."""
    return rows.groupBy(*keys).agg(*summary_columns(horizons))


def score_bucket(score: Column) -> Column:
    """Label of the bucket holding the score, NULL outside all buckets."""
    out = F.lit(None).cast("string")
    for low, high, label in SCORE_BUCKETS:
        out = F.when((score >= low) & (score < high), label).otherwise(out)
    return out


def sma_label(above: Column) -> Column:
    """Readable form of ``above_sma_200``."""
    return F.when(above, "above_SMA").when(~above, "below_SMA").otherwise("SMA_unknown")


def signal_summaries(rows: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """The three summaries (action; action by trend; action by score bucket) in one pass.

    Grouping sets read the signals once; ``summary`` names the grouping, and
    only observed groups appear.
    """
    graded = rows.select(
        F.coalesce(F.nullif("action", F.lit("")), F.lit(NO_ACTION)).alias("action"),
        sma_label(F.col("above_sma_200")).alias("sma"),
        score_bucket(F.col("score")).alias("bucket"),
        *[forward_name(h) for h in horizons],
    )
    sets = [[F.col("action")], [F.col("action"), F.col("sma")], [F.col("action"), F.col("bucket")]]
    grouped = graded.groupingSets(sets, "action", "sma", "bucket").agg(
        F.grouping("sma").alias("_no_sma"), F.grouping("bucket").alias("_no_bucket"), *summary_columns(horizons)
    )
    which = (
        F.when(F.col("_no_sma") == 0, "action_sma")
        .when(F.col("_no_bucket") == 0, "action_bucket")
        .otherwise("action")
    )
    return grouped.withColumn("summary", which).drop("_no_sma", "_no_bucket")


def load_statistics(signals: DataFrame, file_col: str = "file") -> DataFrame:
    """Rows, files, symbols and dates of a loaded signal log."""
    return signals.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(file_col).alias("n_files"),
        F.countDistinct("symbol").alias("n_symbols"),
        F.countDistinct("date").alias("n_dates"),
    )
