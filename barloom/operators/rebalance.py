"""Weekly equal-weight rebalancing backtest as joins and windows.

The target set of a rebalance is the top of that day's scores and does not
depend on what is held, so no day loop is needed: sets are ranked per
rebalance, held sets follow by joins, and the value is one running product.
All tables are keyed by ``scenario`` so that universes, costs or set sizes can
be run side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.exprs import change
from barloom.functions.history import calendar_bounded, over_history, running
from barloom.operators.signals import top_rows
from barloom.session import kept

KEYS = ["scenario"]


@dataclass(frozen=True)
class SimulationResult:
    """``equity_curve`` (scenario, date, value) and ``trades_log`` (scenario, date, symbol, action, score)."""

    equity_curve: DataFrame
    trades_log: DataFrame


def with_scenario(df: DataFrame, name: str = "base") -> DataFrame:
    return df if "scenario" in df.columns else df.withColumn("scenario", F.lit(name))


def day_axis(scores: DataFrame, bars: DataFrame) -> DataFrame:
    """Trading days of each scenario's symbols, numbered, with their rebalances.

    ``rebalance`` counts the rebalance days up to and including the day; a
    rebalance day is the first trading day of its ISO week. One row per
    scenario and calendar day, written once because every step joins it.
    """
    members = with_scenario(scores).select(*KEYS, "symbol").distinct()
    days = bars.select("symbol", "date").join(members, "symbol").select(*KEYS, "date").distinct()
    week = F.date_trunc("week", F.col("date"))
    flagged = over_history(
        days,
        lambda w: {"_monday": week, "_last": F.lag(week).over(w)},
        lambda w: {"is_rebalance": F.coalesce(F.col("_monday") != F.col("_last"), F.lit(True))},
        keys=KEYS,
        back=1,
    )
    counted = running(
        flagged.withColumns({"_flag": F.col("is_rebalance").cast("int"), "_one": F.lit(1)}),
        {"rebalance": ("sum", "_flag"), "day": ("sum", "_one")},
        keys=KEYS,
    )
    numbers = counted.select(
        *KEYS,
        "date",
        "is_rebalance",
        F.col("rebalance").cast("int").alias("rebalance"),
        F.col("day").cast("int").alias("day"),
    )
    ends = {"n_rebalances": F.max("rebalance"), "n_days": F.max("day")}
    if calendar_bounded(days):
        whole = Window.partitionBy(*KEYS)
        return kept(numbers.withColumns({c: end.over(whole) for c, end in ends.items()}), "day-axis")
    numbers = kept(numbers, "day-numbers")
    last = numbers.groupBy(*KEYS).agg(*[end.alias(c) for c, end in ends.items()])
    return kept(numbers.join(last, KEYS), "day-axis")


def weekly_rebalance_dates(scores: DataFrame, bars: DataFrame) -> DataFrame:
    """First trading day of each ISO week."""
    return day_axis(scores, bars).filter("is_rebalance").select(*KEYS, "date", "rebalance")


def daily_score_matrix(scores: DataFrame, bars: DataFrame) -> DataFrame:
    """Long score matrix ``(scenario, date, symbol, filled, score)``.

    ``filled`` is the last known value up to the day, ``score`` the one known
    the day before. Each known value is carried over the run of days up to the
    next one, so the rows produced are exactly the rows of the result.
    """
    axis = day_axis(scores, bars)
    known = (
        with_scenario(scores)
        .filter("proba_up is not null")
        .select(*KEYS, "symbol", "date", "proba_up")
        .join(axis.select(*KEYS, "date", "day", "n_days"), [*KEYS, "date"])
    )
    mine = [*KEYS, "symbol"]
    spread = over_history(
        known, lambda w: {"_until": F.coalesce(F.lead("day").over(w) - 1, F.col("n_days"))}, keys=mine, ahead=1
    ).withColumn("day", F.explode(F.sequence("day", "_until")))
    dated = spread.drop("date").join(axis.select(*KEYS, "day", "date"), [*KEYS, "day"])
    lagged = over_history(dated, lambda w: {"score": F.lag("proba_up").over(w)}, keys=mine, back=1)
    return lagged.select(*KEYS, "date", "symbol", F.col("proba_up").alias("filled"), "score")


def rebalance_scores(scores: DataFrame, axis: DataFrame) -> DataFrame:
    """Scores known the day before each rebalance: ``(scenario, rebalance, symbol, score)``.

    A score of day d counts from d+1 until the day of the next score. The
    rebalances in that span are consecutive numbers, so they are exploded
    instead of joining days by range, and non-rebalance days never appear.
    """
    known = (
        with_scenario(scores)
        .filter("proba_up is not null")
        .select(*KEYS, "symbol", "date", "proba_up")
        .join(axis.select(*KEYS, "date", "rebalance", "n_rebalances"), [*KEYS, "date"])
    )
    return (
        over_history(
            known,
            lambda w: {"_until": F.coalesce(F.lead("rebalance").over(w), F.col("n_rebalances"))},
            keys=[*KEYS, "symbol"],
            ahead=1,
        )
        .filter(F.col("_until") > F.col("rebalance"))
        .withColumn("rebalance", F.explode(F.sequence(F.col("rebalance") + 1, F.col("_until"))))
        .select(*KEYS, "rebalance", "symbol", F.col("proba_up").alias("score"))
    )


def rebalance_ranking(scores: DataFrame, bars: DataFrame, top: int) -> DataFrame:
    """The ``top`` best scores of each rebalance day with their rank."""
    axis = day_axis(scores, bars)
    ranked = top_rows(rebalance_scores(scores, axis), top, [*KEYS, "rebalance"])
    return ranked.join(axis.filter("is_rebalance"), [*KEYS, "rebalance"]).select(
        *KEYS, "date", "symbol", "score", "rank"
    )


def _sets(scores: DataFrame, axis: DataFrame, top_n: int, min_score: float):
    """Effective rebalances (numbered ``step``), their target sets, and the changes between them.

    The scores at the rebalances are written once: they may come from fitted
    models and are needed for the sets, the steps and the log.
    """
    known = kept(rebalance_scores(scores, axis), "rebalance-scores")
    dates = axis.filter("is_rebalance").select(*KEYS, "rebalance", "date")
    # a day without any score keeps the old set: it is not a step
    effective = (
        known.select(*KEYS, "rebalance")
        .distinct()
        .join(dates, [*KEYS, "rebalance"])
        .withColumn("step", F.row_number().over(Window.partitionBy(*KEYS).orderBy("rebalance")))
    )
    chosen = top_rows(known.filter(F.col("score") >= min_score), top_n, [*KEYS, "rebalance"])
    targets = chosen.join(effective, [*KEYS, "rebalance"]).select(*KEYS, "step", "symbol")
    now = targets.withColumn("_now", F.lit(True))
    past = targets.withColumn("step", F.col("step") + 1).withColumn("_past", F.lit(True))
    changes = now.join(past, [*KEYS, "step", "symbol"], "full_outer").join(effective, [*KEYS, "step"])
    return known, effective, targets, changes


def turnover_costs(changes: DataFrame) -> DataFrame:
    """One-way turnover per step from the sizes of the old, new and common set.

    Weights are equal and fully invested, so the cash leg only moves when one
    of the two sets is empty.
    """
    sized = changes.groupBy(*KEYS, "step").agg(
        F.count("_now").alias("n_new"),
        F.count("_past").alias("n_old"),
        F.count_if(F.col("_now") & F.col("_past")).alias("n_common"),
    )
    kept, old, new = F.col("n_common"), F.col("n_old"), F.col("n_new")
    moved = (kept * F.abs(1 / new - 1 / old) + (old - kept) / old + (new - kept) / new) / 2
    return sized.withColumn("one_way", F.when((old == 0) | (new == 0), F.lit(1.0)).otherwise(moved))


def simulate(
    scores: DataFrame,
    bars: DataFrame,
    *,
    top_n: int = 5,
    min_score: float = 0.55,
    costs_bps: float = 5.0,
    initial_capital: float = 1.0,
    rebalance_frequency: str = "weekly",
) -> SimulationResult:
    """Rebalance weekly into the best ``top_n`` scores; costs first, then the day's return.

    ``scores`` is ``([scenario,] symbol, date, proba_up)``; ``bars`` gives the
    closes. A missing close keeps the last one (return 0 that day, the whole
    move on the next bar).
    """
    if rebalance_frequency != "weekly":
        raise ValueError(f"rebalance_frequency must be 'weekly', got {rebalance_frequency!r}")
    axis = day_axis(scores, bars)
    known, effective, targets, changes = _sets(scores, axis, top_n, min_score)

    costs = turnover_costs(changes)
    steps = effective.join(costs, [*KEYS, "step"], "left").select(
        *KEYS, "date", "step", F.coalesce("n_new", F.lit(0)).alias("n_new"),
        F.coalesce("one_way", F.lit(0.0)).alias("one_way"),
    )
    days = running(
        axis.select(*KEYS, "date").join(steps, [*KEYS, "date"], "left"),
        {"held_step": ("last", "step"), "n_held": ("last", "n_new")},
        keys=KEYS,
    )
    held = days.select(*KEYS, "date", F.col("held_step").alias("step")).join(targets, [*KEYS, "step"])
    moves = over_history(
        bars.select("symbol", "date", "close").filter("close is not null"),
        lambda w: {"ret": change(F.col("close"), F.lag("close").over(w))},
        back=1,
    )
    gains = (
        held.join(moves.select("symbol", "date", "ret"), ["symbol", "date"])
        .groupBy(*KEYS, "date")
        .agg(F.sum("ret").alias("gain"))
    )
    after_cost = F.greatest(
        F.lit(0.0), 1 - F.coalesce("one_way", F.lit(0.0)) * F.lit(costs_bps) * F.lit(1e-4)
    )
    portfolio_return = F.coalesce(F.try_divide("gain", "n_held"), F.lit(0.0))
    daily = days.join(gains, [*KEYS, "date"], "left").withColumn(
        "_factor", after_cost * (1 + portfolio_return)
    )
    curve = running(daily, {"_growth": ("product", "_factor")}, keys=KEYS).select(
        *KEYS, "date", (F.lit(initial_capital) * F.col("_growth")).alias("value")
    )
    trades = (
        changes.filter(F.col("_now").isNull() | F.col("_past").isNull())
        .join(known, [*KEYS, "rebalance", "symbol"], "left")
        .select(
            *KEYS,
            "date",
            "symbol",
            F.when(F.col("_now"), "buy").otherwise("sell").alias("action"),
            "score",
        )
    )
    return SimulationResult(curve, trades)


def rebalance_costs(
    scores: DataFrame, bars: DataFrame, *, top_n: int = 5, min_score: float = 0.55, costs_bps: float = 5.0
) -> DataFrame:
    """Set sizes, one-way turnover and cost fraction of every step that trades."""
    axis = day_axis(scores, bars)
    _, effective, _, changes = _sets(scores, axis, top_n, min_score)
    return (
        effective.join(turnover_costs(changes), [*KEYS, "step"])
        .withColumn("cost_fraction", F.col("one_way") * F.lit(costs_bps) * F.lit(1e-4))
        .select(*KEYS, "date", "n_old", "n_new", "n_common", "one_way", "cost_fraction")
    )


def held_returns(
    scores: DataFrame, bars: DataFrame, *, top_n: int = 5, min_score: float = 0.55
) -> DataFrame:
    """Equal-weight return of the held set per day, before costs."""
    free = simulate(scores, bars, top_n=top_n, min_score=min_score, costs_bps=0.0).equity_curve
    return over_history(
        free,
        lambda w: {"portfolio_return": change(F.col("value"), F.coalesce(F.lag("value").over(w), F.lit(1.0)))},
        keys=KEYS,
        back=1,
    ).select(*KEYS, "date", "portfolio_return")
