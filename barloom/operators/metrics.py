"""Return and classification metrics as grouped aggregates.

Every function takes one row per observation and returns one row per group; an
empty input gives no row. Running equity curves are the only windows needed,
everything else is a partial aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import no_nan, ratio
from barloom.functions.history import calendar_bounded, over_history, running

TRADING_DAYS = 252
FLAT_DEVIATION = 1e-14


# --- aggregate expressions -------------------------------------------------


def total_return(ret: Column) -> Column:
    """Compounded return of all rows."""
    return F.product(1 + ret) - 1


def cagr(ret: Column, periods: int = TRADING_DAYS) -> Column:
    """Compounded return scaled to one year of ``periods`` rows."""
    return no_nan(F.pow(F.product(1 + ret), F.lit(float(periods)) / F.count(F.lit(1)))) - 1


def volatility(ret: Column, periods: int = TRADING_DAYS) -> Column:
    """Annualised sample deviation."""
    return F.stddev_samp(ret) * math.sqrt(periods)


def sharpe(ret: Column, risk_free: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    """Annualised mean over deviation of the excess return; NULL when flat."""
    excess = ret - risk_free / periods
    dev = F.stddev_samp(excess)
    return F.when(dev >= FLAT_DEVIATION, F.avg(excess) / dev * math.sqrt(periods))


def hit_rate(ret: Column) -> Column:
    """Share of rows with a gain."""
    return F.avg((ret > 0).cast("double"))


# --- return summaries ------------------------------------------------------


def return_summary(
    rows: DataFrame,
    series: dict[str, tuple[str, str | None]],
    keys: Sequence[str] = ("symbol",),
    risk_free: float = 0.0,
    periods: int = TRADING_DAYS,
) -> DataFrame:
    """All return metrics of one or more return columns, one row per group.

    ``series`` maps an output prefix to ``(return column, position column)``;
    a position column adds the turnover. The drawdown peak starts at the first
    row after its return, so a single loss has no drawdown.
    """
    moved = _curves(rows, {p: r for p, (r, _) in series.items()}, {p: c for p, (_, c) in series.items() if c}, keys)
    aggs = []
    for p, (r, c) in series.items():
        ret = F.col(r)
        fall = ratio(F.col(f"_eq_{p}") - F.col(f"_pk_{p}"), F.col(f"_pk_{p}"))
        aggs += [
            total_return(ret).alias(f"{p}total_return"),
            cagr(ret, periods).alias(f"{p}cagr"),
            volatility(ret, periods).alias(f"{p}volatility"),
            sharpe(ret, risk_free, periods).alias(f"{p}sharpe"),
            F.min(fall).alias(f"{p}max_drawdown"),
            hit_rate(ret).alias(f"{p}hit_rate"),
        ]
        if c:
            aggs.append(F.avg(f"_to_{p}").alias(f"{p}turnover"))
    return moved.groupBy(*keys).agg(*aggs)


def max_drawdown(rows: DataFrame, ret: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Deepest fall of the compounded curve from its running peak."""
    curve = _curves(rows, {"": ret}, {}, keys)
    fall = ratio(F.col("_eq_") - F.col("_pk_"), F.col("_pk_"))
    return curve.groupBy(*keys).agg(F.min(fall).alias("max_drawdown"))


def _curves(rows: DataFrame, returns: dict[str, str], positions: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Rows with their equity ``_eq_*``, its peak so far ``_pk_*`` and position change ``_to_*``.

    With a ``DATE`` all windows share one sort of the history. Intraday rows are
    shuffled once by day: the curve of each day starts at 1 and is moved by what
    the days before made of it. Where that is negative, a day's peak is its lowest
    value.
    """
    if calendar_bounded(rows):
        grown = rows.withColumns({f"_g_{p}": 1 + F.col(r) for p, r in returns.items()})
        curves = running(grown, {f"_eq_{p}": ("product", f"_g_{p}") for p in returns}, keys=keys)
        peaks = running(curves, {f"_pk_{p}": ("max", f"_eq_{p}") for p in returns}, keys=keys)
        w = Window.partitionBy(*keys).orderBy("date")
        return peaks.withColumns({f"_to_{p}": F.abs(F.col(c) - F.lag(c).over(w)) for p, c in positions.items()})

    turn = Window.partitionBy(*keys, "_cut").orderBy("date")
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        rows.withColumn("_cut", F.to_date("date"))
        .withColumns({f"_eq_{p}": F.product(1 + F.col(r)).over(so_far) for p, r in returns.items()})
        .withColumns({f"_hi_{p}": F.max(f"_eq_{p}").over(so_far) for p in returns})
        .withColumns({f"_lo_{p}": F.min(f"_eq_{p}").over(so_far) for p in returns})
        .withColumns({f"_was_{p}": F.lag(c).over(turn) for p, c in positions.items()})
        .withColumn("_first", F.row_number().over(turn) == 1)
    )
    sums = []
    for p, r in returns.items():
        sums += [F.product(1 + F.col(r)).alias(f"_all_{p}"), F.max(f"_eq_{p}").alias(f"_top_{p}"), F.min(f"_eq_{p}").alias(f"_low_{p}")]
    sums += [F.max_by(c, "date").alias(f"_end_{p}") for p, c in positions.items()]
    by_day = Window.partitionBy(*keys).orderBy("_cut")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    days = inside.groupBy(*keys, "_cut").agg(*sums)
    days = days.withColumns({f"_c_{p}": F.product(f"_all_{p}").over(before) for p in returns})
    days = days.withColumns({f"_p_{p}": F.max(_moved(p, f"_top_{p}", f"_low_{p}")).over(before) for p in returns})
    days = days.withColumns({f"_e_{p}": F.lag(f"_end_{p}").over(by_day) for p in positions})
    carried = days.select(
        *keys, "_cut", *[f"_{k}_{p}" for k in "cp" for p in returns], *[f"_e_{p}" for p in positions]
    )
    joined = inside.join(carried, [*keys, "_cut"])
    made = {}
    for p in returns:
        made[f"_pk_{p}"] = F.greatest(f"_p_{p}", _moved(p, f"_hi_{p}", f"_lo_{p}"))
        made[f"_eq_{p}"] = F.coalesce(F.col(f"_eq_{p}") * F.col(f"_c_{p}"), f"_eq_{p}", f"_c_{p}")
    for p, c in positions.items():
        was = F.when(F.col("_first"), F.col(f"_e_{p}")).otherwise(F.col(f"_was_{p}"))
        made[f"_to_{p}"] = F.abs(F.col(c) - was)
    return joined.withColumns(made).select(*rows.columns, *made)


def _moved(p: str, high: str, low: str) -> Column:
    """Highest value of a day's curve, moved by the days before."""
    carry = F.coalesce(f"_c_{p}", F.lit(1.0))
    return carry * F.when(carry < 0, F.col(low)).otherwise(F.col(high))


def turnover(rows: DataFrame, pos: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean absolute position change; the first row has none."""
    moved = over_history(
        rows, lambda w: {"_to": F.abs(F.col(pos) - F.lag(pos).over(w))}, keys=keys, back=1
    )
    return moved.groupBy(*keys).agg(F.avg("_to").alias("turnover"))


# --- classification --------------------------------------------------------


def _cells(truth: str, guess: str, positive: int = 1) -> dict[str, Column]:
    t, g = F.col(truth) == positive, F.col(guess) == positive
    return {
        "tn": F.count_if(~t & ~g),
        "fp": F.count_if(~t & g),
        "fn": F.count_if(t & ~g),
        "tp": F.count_if(t & g),
    }


def confusion_matrix(
    rows: DataFrame, truth: str = "y", guess: str = "prediction", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The four counts ``tn, fp, fn, tp`` of each group."""
    return rows.groupBy(*keys).agg(*[c.alias(k) for k, c in _cells(truth, guess).items()])


def class_summary(
    rows: DataFrame,
    truth: str = "y",
    guess: str = "prediction",
    keys: Sequence[str] = ("symbol",),
    positive: int = 1,
) -> DataFrame:
    """Accuracy, precision and recall; a missing denominator counts as 0."""
    return rows.groupBy(*keys).agg(*_class_scores(truth, guess, positive))


def _class_scores(truth: str, guess: str, positive: int = 1) -> list[Column]:
    c = _cells(truth, guess, positive)
    zero = F.lit(0.0)
    return [
        F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"),
        F.coalesce(ratio(c["tp"], c["tp"] + c["fp"]), zero).alias("precision"),
        F.coalesce(ratio(c["tp"], c["tp"] + c["fn"]), zero).alias("recall"),
    ]


def classification_report(
    rows: DataFrame, truth: str = "y", guess: str = "prediction", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support, as long rows.

    Only classes seen in the truth or the predictions are listed. Everything
    comes from the four counts, so the rows are read once.
    """
    counts = confusion_matrix(rows, truth, guess, keys)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")

    def line(label: str, hit: Column, guessed: Column, real: Column) -> Column:
        p = F.coalesce(ratio(hit, guessed), F.lit(0.0))
        r = F.coalesce(ratio(hit, real), F.lit(0.0))
        f1 = F.coalesce(ratio(2 * hit, guessed + real), F.lit(0.0))
        return F.struct(
            F.lit(label).alias("label"),
            p.alias("precision"),
            r.alias("recall"),
            f1.alias("f1_score"),
            real.cast("long").alias("support"),
            ((guessed + real) > 0).alias("seen"),
        )

    base = counts.select(
        *keys,
        n.alias("n"),
        ((F.col("tn") + F.col("tp")) / n).alias("acc"),
        line("0", F.col("tn"), F.col("tn") + F.col("fn"), F.col("tn") + F.col("fp")).alias("c0"),
        line("1", F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")).alias("c1"),
    )
    seen = F.col("c0.seen").cast("int") + F.col("c1.seen").cast("int")

    def mean(field: str, weighted: bool) -> Column:
        parts = []
        for c in ("c0", "c1"):
            share = F.col(f"{c}.support") / F.col("n") if weighted else F.col(f"{c}.seen").cast("int") / seen
            parts.append(F.col(f"{c}.{field}") * share)
        return (parts[0] + parts[1]).alias(field)

    def average(label: str, weighted: bool) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            *[mean(f, weighted) for f in ("precision", "recall", "f1_score")],
            F.col("n").alias("support"),
            F.lit(True).alias("seen"),
        )

    none = F.lit(None).cast("double")
    overall = F.struct(
        F.lit("accuracy").alias("label"),
        none.alias("precision"),
        none.alias("recall"),
        F.col("acc").alias("f1_score"),
        F.col("n").alias("support"),
        F.lit(True).alias("seen"),
    )
    lines = F.array(
        F.col("c0"), F.col("c1"), overall, average("macro avg", False), average("weighted avg", True)
    )
    return (
        base.select(*keys, F.explode(lines).alias("line"))
        .select(*keys, "line.*")
        .filter("seen")
        .drop("seen")
    )


# --- everything together ---------------------------------------------------


def evaluate(
    predictions: DataFrame,
    truth: DataFrame,
    backtest: DataFrame,
    keys: Sequence[str] = ("symbol",),
    risk_free: float = 0.0,
    periods: int = TRADING_DAYS,
) -> DataFrame:
    """Classification, strategy and buy-and-hold metrics, one wide row per group.

    ``predictions`` holds ``prediction``, ``truth`` holds ``y``. ``n_unmatched``
    counts dates found in only one of the two; use :func:`require_aligned` to
    refuse them.
    """
    missing = {"strategy_return", "asset_return", "position"} - set(backtest.columns)
    if missing:
        raise KeyError(f"backtest is missing columns {sorted(missing)}")
    on = [*keys, "date"]
    both = predictions.select(*on, "prediction").join(truth.select(*on, "y"), on, "full_outer")
    # a date missing on one side compares to NULL and enters no count but the last
    unmatched = F.count_if(F.col("prediction").isNull() | F.col("y").isNull())
    ml = both.groupBy(*keys).agg(*_class_scores("y", "prediction"), unmatched.alias("n_unmatched"))
    returns = return_summary(
        backtest,
        {"strategy_": ("strategy_return", "position"), "buy_and_hold_": ("asset_return", None)},
        keys,
        risk_free,
        periods,
    )
    return ml.join(returns, list(keys))


def require_aligned(report: DataFrame) -> None:
    """Raise when predictions and labels of some group cover different dates."""
    bad = report.filter("n_unmatched > 0").limit(5).collect()
    if bad:
        raise ValueError(f"predictions and labels must share the same dates: {bad}")
