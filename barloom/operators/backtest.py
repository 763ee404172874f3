"""Turn predictions into positions, costs and returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.exprs import change, trailing
from barloom.functions.history import over_history, running


def run_backtest(
    predictions: DataFrame,
    close: DataFrame | None = None,
    costs_bps: float = 0.0,
    holding_period: int = 1,
    keys: Sequence[str] = ("symbol",),
    *,
    holding_column: str | None = None,
    holding_choices: Sequence[int] = (),
) -> DataFrame:
    """Daily strategy and buy-and-hold returns of 0/1 predictions.

    A prediction acts one row later and is held for ``holding_period`` rows.
    Rows are matched by date first and returns are taken between the matched
    rows, so a missing prediction date makes the next return span several bars.
    Costs are charged on position changes; the first entry is free.

    ``close`` is joined on the keys it shares with ``predictions``. Without it
    the predictions' own ``close`` column is used, and features, folds and
    backtest then share one shuffle by symbol. A table mixing holding periods names them in ``holding_column`` and lists the
    possible values in ``holding_choices``.
    """
    if holding_period < 1 or any(h < 1 for h in holding_choices):
        raise ValueError("holding_period must be at least 1")
    if close is None:
        matched = predictions.filter("close is not null")
    else:
        on = [k for k in keys if k in close.columns]
        matched = predictions.drop("close").join(close.select(*on, "date", "close"), [*on, "date"])
    periods = list(holding_choices) if holding_column else [holding_period]

    def lagged(w: WindowSpec) -> dict[str, Column]:
        return {
            "asset_return": change(F.col("close"), F.lag("close").over(w)),
            "_signal": F.lag("prediction").over(w).cast("double"),
        }

    def held(w: WindowSpec) -> dict[str, Column]:
        def over(n: int) -> Column:
            if n == 1:
                return F.col("_signal")
            # least() would skip NULL and turn "no signal yet" into a full position
            top = F.max("_signal").over(trailing(w, n))
            return F.when(top.isNotNull(), F.least(top, F.lit(1.0)))

        if not holding_column:
            return {"position": over(periods[0])}
        chosen = F.lit(None).cast("double")
        for n in periods:
            chosen = F.when(F.col(holding_column) == n, over(n)).otherwise(chosen)
        return {"position": chosen}

    def traded(w: WindowSpec) -> dict[str, Column]:
        gross = F.col("position") * F.col("asset_return")
        if costs_bps <= 0:
            return {"strategy_return": gross}
        turned = F.abs(F.col("position") - F.lag("position").over(w))
        return {"strategy_return": gross - F.coalesce(turned, F.lit(0.0)) * F.lit(costs_bps) / 10_000}

    daily = over_history(matched, lagged, held, traded, keys=keys, back=max(periods) + 2)
    kept = daily.filter(F.col("position").isNotNull() & F.col("asset_return").isNotNull())
    grown = kept.withColumns(
        {"_gs": 1 + F.col("strategy_return"), "_ga": 1 + F.col("asset_return")}
    )
    curves = running(
        grown, {"cumulative": ("product", "_gs"), "buy_and_hold": ("product", "_ga")}, keys=keys
    )
    extra = [holding_column] if holding_column and holding_column not in keys else []
    return curves.select(
        *keys,
        *extra,
        "date",
        "close",
        "asset_return",
        F.col("prediction").cast("double").alias("prediction"),
        "position",
        "strategy_return",
        "cumulative",
        "buy_and_hold",
    )
