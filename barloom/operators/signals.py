"""Buy / hold / sell / blocked signals from a ranking and the held positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numbering import numbered

# Output order of the actions.
ACTION_ORDER = {"buy": 1, "hold": 2, "sell": 3, "blocked": 4}


def check_signal_inputs(
    ranking: DataFrame, top_n: int, min_score: float, min_score_downtrend: float
) -> None:
    missing = {"symbol", "score"} - set(ranking.columns)
    if missing:
        raise ValueError(f"ranking is missing columns {sorted(missing)}")
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    if not (0.0 <= min_score <= 1.0 and 0.0 <= min_score_downtrend <= 1.0):
        raise ValueError("score limits must lie in [0, 1]")
    if min_score_downtrend < min_score:
        raise ValueError("min_score_downtrend must not be below min_score")


def top_rows(rows: DataFrame, n: int, keys: Sequence[str], score: str = "score", out: str = "rank") -> DataFrame:
    """The ``n`` best rows per group with their rank, ties by symbol.

    The rank filter sits right on the window, so every task keeps at most ``n``
    rows per group before the shuffle: a date with a huge universe stays cheap.
    """
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("symbol"))
    return rows.withColumn(out, F.row_number().over(best)).filter(F.col(out) <= n)


def generate_signals(
    ranking: DataFrame,
    held: DataFrame,
    *,
    top_n: int = 5,
    min_score: float = 0.55,
    min_score_downtrend: float = 0.62,
    keys: Sequence[str] = ("as_of",),
) -> DataFrame:
    """``(keys, symbol, action, score, reason)``, one row per relevant symbol.

    ``ranking`` and ``held`` carry the same group ``keys`` (a date, an account,
    a scenario). A symbol known to be below its long average needs the stricter
    score; a missing average is neutral.
    """
    check_signal_inputs(ranking, top_n, min_score, min_score_downtrend)
    on = [*keys, "symbol"]
    has_trend = "above_sma_200" in ranking.columns
    down = F.coalesce(~F.col("above_sma_200"), F.lit(False)) if has_trend else F.lit(False)
    passing = F.col("score") >= min_score
    held_back = passing & down & (F.col("score") < min_score_downtrend)
    yes, no = F.lit(True), F.lit(False)
    graded = ranking.filter("score is not null").select(*on, "score", held_back.alias("is_blocked"))
    eligible = graded.filter((F.col("score") >= min_score) & ~F.col("is_blocked"))
    # ranking, holdings and targets are stacked and folded per symbol: one
    # partial aggregate instead of an outer and a left join
    stacked = (
        graded.unionByName(held.select(*on, yes.alias("is_held")), allowMissingColumns=True)
        .unionByName(
            top_rows(eligible, top_n, keys).select(*on, yes.alias("in_target")), allowMissingColumns=True
        )
        .groupBy(*on)
        .agg(
            F.max("score").alias("score"),
            *[F.coalesce(F.bool_or(c), no).alias(c) for c in ("is_blocked", "is_held", "in_target")],
        )
    )
    is_held, in_target, blocked = F.col("is_held"), F.col("in_target"), F.col("is_blocked")
    action = (
        F.when(in_target & is_held, "hold")
        .when(in_target, "buy")
        .when(is_held, "sell")
        .when(blocked, "blocked")
    )
    reason = F.when(
        blocked,
        F.format_string(
            "blocked: below SMA200 and score %.3f < min_score_downtrend " + str(min_score_downtrend),
            F.col("score"),
        ),
    ).otherwise(F.lit(""))
    return (
        stacked.select(*on, action.alias("action"), "score", reason.alias("reason"))
        .filter("action is not null")
    )


def action_rank(col: Column) -> Column:
    """1..4 in output order."""
    out = F.lit(None).cast("int")
    for name, rank in ACTION_ORDER.items():
        out = F.when(col == name, F.lit(rank)).otherwise(out)
    return out


def order_signals(signals: DataFrame, keys: Sequence[str] = ("as_of",)) -> DataFrame:
    """Sorted output: buys, holds, sells, blocked; best score first, missing last."""
    return signals.orderBy(
        *keys, action_rank(F.col("action")), F.col("score").desc_nulls_last(), "symbol"
    )


def signal_sequence(signals: DataFrame, keys: Sequence[str] = ("as_of",), out: str = "seq") -> DataFrame:
    """Number the signals of each group in output order, from 1.

    Counted in two levels, so one group is spread over many tasks.
    """
    order = [action_rank(F.col("action")), F.col("score").desc_nulls_last(), F.col("symbol")]
    return numbered(signals, keys, order, out)


def candidate_table(
    ranking: DataFrame,
    held: DataFrame,
    *,
    top_n: int = 5,
    min_score: float = 0.55,
    shown: int = 10,
    keys: Sequence[str] = ("as_of",),
) -> DataFrame:
    """The best ``shown`` symbols per group with a status and a held mark."""
    best = top_rows(ranking.filter("score is not null"), shown, keys)
    owned = held.select(*keys, "symbol").distinct().withColumn("_held", F.lit(True))
    status = (
        F.when(F.col("rank") > top_n, "")
        .when(F.col("score") >= min_score, "eligible")
        .otherwise("(below min_score)")
    )
    return (
        best.join(owned, [*keys, "symbol"], "left")
        .withColumn("status", status)
        .withColumn("held_mark", F.when(F.col("_held"), "*").otherwise(""))
        .drop("_held")
    )
