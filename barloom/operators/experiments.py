"""Experiment grid: symbols x periods x configurations x models in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import change, fan_out, trailing
from barloom.functions.history import over_history
from barloom.operators.backtest import run_backtest
from barloom.operators.features import CLOSE, FEATURE_COLUMNS, feature_stages
from barloom.operators.metrics import return_summary
from barloom.operators.models import Model, kind_of
from barloom.operators.splits import AdaptiveSplit, Splitter
from barloom.operators.targets import target_column
from barloom.operators.walkforward import by_history, threshold_signal, walk_forward_scores
from barloom.session import kept

KEYS = ["symbol", "period", "config"]


@dataclass(frozen=True)
class Config:
    """A target with the number of rows a signal is held."""

    label: str
    target: str
    holding_period: int


# The three configurations, the costs and the probability cut.
CONFIGS = (
    Config("dir/hp1", "direction", 1),
    Config("5d/hp5", "direction_5d", 5),
    Config("thr/hp1", "threshold", 1),
)
COSTS_BPS = 5.0
CUT = 0.50


def grid_dataset(bars: DataFrame, periods: list[dict], configs=CONFIGS) -> DataFrame:
    """Labelled rows of every (symbol, period, config).

    ``periods`` are dicts ``{"period", "start", "end"}``. Features and all
    targets of a period share one sort; only then is a row copied per config.
    """
    types = {"period": "string", "start": "date", "end": "date"}
    inside = fan_out(bars.select("symbol", "date", CLOSE), periods, types).filter(
        F.col("date").between(F.col("start"), F.col("end"))
    )
    names = {c.label: f"_y{i}" for i, c in enumerate(configs)}
    full = over_history(
        inside.select("symbol", "period", "date", CLOSE),
        *feature_stages(),
        lambda w: {names[c.label]: target_column(w, c.target) for c in configs},
        keys=["symbol", "period"],
        back=21,
        ahead=5,
    )
    labelled = F.array(
        *[
            F.struct(
                F.lit(c.label).alias("config"),
                F.lit(c.holding_period).alias("holding_period"),
                F.col(names[c.label]).alias("y"),
            )
            for c in configs
        ]
    )
    spread = full.na.drop(subset=FEATURE_COLUMNS).select(
        "symbol", "period", "date", CLOSE, *FEATURE_COLUMNS, F.explode(labelled).alias("_c")
    )
    return spread.select(
        *KEYS[:2], "_c.config", "_c.holding_period", "date", CLOSE, *FEATURE_COLUMNS, "_c.y"
    ).filter("y is not null")


def run_grid(
    bars: DataFrame,
    periods: list[dict],
    models: dict[str, Model],
    configs=CONFIGS,
    splitter: Splitter = AdaptiveSplit(),
    costs_bps: float = COSTS_BPS,
    cut: float = CUT,
) -> DataFrame:
    """One metric row per symbol, period, config and model; short histories drop out.

    The labelled rows and the predictions are written once: every model reads
    the former, accuracy and backtest read the latter, and no model is fitted
    twice.
    """
    dataset = kept(grid_dataset(bars, periods, configs), "grid-dataset")
    holding = F.lit(None).cast("int")
    for c in configs:
        holding = F.when(F.col("config") == c.label, F.lit(c.holding_period)).otherwise(holding)
    scored = None
    for name, model in models.items():
        rows = by_history(dataset, KEYS) if kind_of(model) == "history" else dataset
        part = threshold_signal(walk_forward_scores(rows, model, splitter, KEYS), cut).select(
            *KEYS, F.lit(name).alias("model"), "date", CLOSE, "y", "prediction"
        )
        scored = part if scored is None else scored.unionByName(part)
    scored = kept(scored, "grid-predictions")
    keys = [*KEYS, "model"]
    tests = run_backtest(
        scored.withColumn("holding_period", holding),
        costs_bps=costs_bps,
        keys=keys,
        holding_column="holding_period",
        holding_choices=sorted({c.holding_period for c in configs}),
    )
    ml = scored.groupBy(*keys).agg(
        F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"),
        (F.avg(F.col("prediction").cast("double")) * 100.0).alias("long_pct"),
    )
    returns = return_summary(tests, {"": ("strategy_return", "position")}, keys)
    return ml.join(returns, keys).select(
        *keys, "accuracy", "total_return", "sharpe", "max_drawdown", "turnover", "long_pct"
    )


def best_per_group(rows: DataFrame, keys=("symbol", "period"), baseline: str = "AlwaysLong") -> DataFrame:
    """Best row by Sharpe per group, and whether a trained model beat the baseline.

    Groups without any Sharpe give no row. Ties go to the first config and
    model by name; Sharpe values are compared at ten decimals, because the same
    returns summed in another order differ in the last digits.
    """
    group = Window.partitionBy(*keys)
    best = group.orderBy(F.round("sharpe", 10).desc(), "config", "model")
    trained, base = _best_sharpes(baseline)
    return (
        rows.filter("sharpe is not null")
        .withColumns(
            {
                "_rn": F.row_number().over(best),
                "_trained": trained.over(group),
                "_base": base.over(group),
            }
        )
        .filter("_rn = 1")
        .withColumn("trained_beat", _won("_trained", "_base"))
        .drop("_rn", "_trained", "_base")
    )


def _best_sharpes(baseline: str):
    """Best Sharpe of the trained models and of the baseline, as aggregates."""
    trained = F.col("model") != baseline
    return F.max(F.when(trained, F.col("sharpe"))), F.max(F.when(~trained, F.col("sharpe")))


def _won(trained: str, base: str):
    ahead = F.col(base).isNull() | (F.col(trained) > F.col(base))
    return F.col(trained).isNotNull() & ahead


def beat_count(rows: DataFrame, keys=("symbol", "period"), baseline: str = "AlwaysLong") -> DataFrame:
    """How many groups there are and in how many a trained model won."""
    trained, base = _best_sharpes(baseline)
    groups = rows.groupBy(*keys).agg(trained.alias("_trained"), base.alias("_base"))
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(_won("_trained", "_base")).alias("n_trained_beat")
    )


def threshold_sweep(
    scores: DataFrame,
    cuts: list[float],
    costs_bps: float = COSTS_BPS,
    holding_period: int = 1,
) -> DataFrame:
    """Backtest quality for several probability cuts at once, per symbol and cut.

    ``scores`` carry ``proba_up`` and ``close``. A row is held if the highest score
    of the rows that it follows exceeds the cut, so one window serves all cuts
    and no row is copied per cut.
    """
    if not cuts:
        raise ValueError("at least one cut is needed")
    if holding_period < 1:
        raise ValueError("holding_period must be at least 1")
    daily = over_history(
        scores.select("symbol", "date", CLOSE, "proba_up").filter(F.col(CLOSE).isNotNull()),
        lambda w: {"_ret": change(F.col(CLOSE), F.lag(CLOSE).over(w)), "_last": F.lag("proba_up").over(w)},
        lambda w: {"_top": F.max("_last").over(trailing(w, holding_period))},
        lambda w: {"_before": F.lag("_top").over(w)},
        back=holding_period + 2,
    ).filter("_top IS NOT NULL AND _ret IS NOT NULL")
    series, columns = {}, {}
    for i, cut in enumerate(cuts):
        position, old = ((F.col(c) > cut).cast("double") for c in ("_top", "_before"))
        gross = position * F.col("_ret")
        paid = F.coalesce(F.abs(position - old), F.lit(0.0)) * F.lit(costs_bps) / 10_000
        columns |= {f"_pos_{i}": position, f"_ret_{i}": gross - paid if costs_bps > 0 else gross}
        series[f"c{i}_"] = (f"_ret_{i}", f"_pos_{i}")
    wide = return_summary(daily.withColumns(columns).select("symbol", "date", *columns), series)
    names = [c.removeprefix("c0_") for c in wide.columns if c.startswith("c0_")]
    lines = [
        F.struct(F.lit(float(cut)).alias("cut"), *[F.col(f"c{i}_{n}").alias(n) for n in names])
        for i, cut in enumerate(cuts)
    ]
    return wide.select("symbol", F.inline(F.array(*lines)))
