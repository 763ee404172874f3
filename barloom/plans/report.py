"""End-to-end chains from the test tables to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.backtest import run_backtest
from barloom.operators.metrics import return_summary
from barloom.operators.models import Model, PreviousDirection
from barloom.operators.splits import Splitter
from barloom.operators.walkforward import run_walk_forward
from barloom.plans import inputs


def rule_report(
    spark: SparkSession,
    sf_dir: str,
    splitter: Splitter,
    model: Model = PreviousDirection(),
    costs_bps: float = 5.0,
) -> DataFrame:
    """Bars, features, folds, predictions, backtest and metrics, one row per symbol."""
    predictions = run_walk_forward(inputs.bars(spark, sf_dir), model, splitter)
    daily = run_backtest(predictions, costs_bps=costs_bps)
    return return_summary(daily, {"": ("strategy_return", "position")}).orderBy("symbol")
