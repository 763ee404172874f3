"""Rank a universe by its latest score and add market context."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import change, full_window
from barloom.functions.history import over_history
from barloom.operators.models import AlwaysLong, Model
from barloom.operators.splits import Splitter
from barloom.operators.targets import make_dataset
from barloom.operators.walkforward import run_walk_forward_proba, unfit_histories
from barloom.sources.bars import slice_dates

# The context columns, in order.
CONTEXT_COLUMNS = ["return_20d", "return_60d", "volatility_20d", "price_vs_sma_200", "above_sma_200"]
YEAR = 252


def latest_scores(scores: DataFrame, keys: Sequence[str] = ("symbol",), score: str = "proba_up") -> DataFrame:
    """Last score of each symbol, best first (ties by symbol)."""
    last = scores.groupBy(*keys).agg(F.max_by(score, "date").alias("score"))
    return last.orderBy(F.col("score").desc(), *keys)


def rank_universe(
    bars: DataFrame,
    model: Model,
    splitter: Splitter,
    target: str = "direction",
    *,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """``(symbol, score)``: P(up) on each symbol's last out-of-sample date.

    Symbols that the model cannot be fitted to drop out; :func:`skipped_symbols`
    lists them with the reason.
    """
    scores = run_walk_forward_proba(slice_dates(bars, start, end), model, splitter, target)
    return latest_scores(scores)


def skipped_symbols(bars: DataFrame, splitter: Splitter, target: str = "direction", model: Model = AlwaysLong()) -> DataFrame:
    """``(symbol, n, reason)`` of the symbols that get no score, and why.

    Too few usable rows for the splitter, or too few rows of a class in the
    first training part for ``model``; ``n`` is the number that was too small.
    """
    every = bars.select("symbol").distinct().join(make_dataset(bars, target), "symbol", "left")
    return unfit_histories(every, model, splitter)


def context_history(bars: DataFrame) -> DataFrame:
    """Context columns for every bar, so past signal dates can look up theirs."""
    root = math.sqrt(YEAR)
    res = over_history(
        bars.select("symbol", "date", "close").filter("close is not null"),
        lambda w: {
            "_ret": change(F.col("close"), F.lag("close").over(w)),
            "return_20d": change(F.col("close"), F.lag("close", 20).over(w)),
            "return_60d": change(F.col("close"), F.lag("close", 60).over(w)),
            "_sma": full_window(F.avg, F.col("close"), w, 200),
        },
        lambda w: {
            "volatility_20d": full_window(F.stddev_samp, F.col("_ret"), w, 20) * root,
            "price_vs_sma_200": change(F.col("close"), F.col("_sma")),
            "above_sma_200": F.col("close") > F.col("_sma"),
        },
        back=200,
    )
    return res.select("symbol", "date", *CONTEXT_COLUMNS)


def latest_context(bars: DataFrame) -> DataFrame:
    """Context of each symbol's last bar.

    Only the last 200 bars of a symbol are ranked and kept; Spark prunes the
    rest before the shuffle (window group limit), then one aggregate follows.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    tail = (
        bars.select("symbol", "date", "close")
        .filter("close is not null")
        .withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= 200)
    )
    stepped = tail.withColumn("_ret", change(F.col("close"), F.lead("close").over(newest)))

    def at(n: int):
        return F.max(F.when(F.col("_back") == n, F.col("close")))

    recent = F.when(F.col("_back") <= 20, F.col("_ret"))
    sma = F.when(F.count("*") >= 200, F.avg("close"))
    return stepped.groupBy("symbol").agg(
        change(at(1), at(21)).alias("return_20d"),
        change(at(1), at(61)).alias("return_60d"),
        F.when(F.count(recent) >= 20, F.stddev_samp(recent) * math.sqrt(YEAR)).alias("volatility_20d"),
        change(at(1), sma).alias("price_vs_sma_200"),
        (at(1) > sma).alias("above_sma_200"),
    )


def enrich_with_context(ranking: DataFrame, bars: DataFrame) -> DataFrame:
    """Left-join the context; a symbol without bars keeps NULLs.

    A ranking with an ``as_of`` date gets the context of that date, otherwise
    the latest.
    """
    if "as_of" in ranking.columns:
        history = context_history(bars).withColumnRenamed("date", "as_of")
        return ranking.join(history, ["symbol", "as_of"], "left")
    return ranking.join(latest_context(bars), "symbol", "left")


def rule_score(bars: DataFrame, window: int = 20) -> DataFrame:
    """``(symbol, date, score)``: share of up days among the last ``window`` moves."""
    res = over_history(
        bars.select("symbol", "date", "close"),
        lambda w: {"_up": (F.col("close") > F.lag("close").over(w)).cast("double")},
        lambda w: {"score": full_window(F.avg, F.col("_up"), w, window)},
        back=window + 1,
    )
    return res.filter("score is not null").select("symbol", "date", "score")
