"""Backward-looking features of a price panel.

Every operator adds one column to a ``(symbol, date, close)`` panel and looks
only at the current and earlier rows of the same symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.exprs import change, full_window, ratio
from barloom.functions.history import over_history

# The model's input columns, in order.
FEATURE_COLUMNS = [
    "return_1d",
    "log_return_1d",
    "return_lag1",
    "return_lag2",
    "return_lag3",
    "rolling_mean_10",
    "rolling_vol_10",
    "sma_ratio_5_20",
    "rsi_14",
    "vol_ratio_5_20",
    "price_vs_mean_20",
]

CLOSE = "close"


def _lagged_return(w: WindowSpec, lag: int) -> Column:
    recent = F.col(CLOSE) if lag == 0 else F.lag(CLOSE, lag).over(w)
    return change(recent, F.lag(CLOSE, lag + 1).over(w))


def daily_returns(bars: DataFrame, out: str = "daily_return", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``close / previous close - 1``."""
    return lagged_returns(bars, 0, out, keys)


def log_returns(bars: DataFrame, out: str = "log_return", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Natural log of ``close / previous close``."""
    return over_history(
        bars, lambda w: {out: F.ln(ratio(F.col(CLOSE), F.lag(CLOSE).over(w)))}, keys=keys, back=1
    )


def lagged_returns(
    bars: DataFrame, lag: int, out: str = "lagged_return", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The daily return of ``lag`` rows ago."""
    if lag < 0:
        raise ValueError("lag must not be negative")
    return over_history(bars, lambda w: {out: _lagged_return(w, lag)}, keys=keys, back=lag + 1)


def rolling_mean(
    bars: DataFrame, window: int, out: str = "rolling_mean", col: str = CLOSE, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Mean of the last ``window`` values."""
    return over_history(
        bars, lambda w: {out: full_window(F.avg, F.col(col), w, window)}, keys=keys, back=window
    )


def rolling_volatility(
    bars: DataFrame, window: int, out: str = "rolling_volatility", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Sample deviation of the last ``window`` daily returns."""
    res = over_history(
        bars,
        lambda w: {"_ret": _lagged_return(w, 0)},
        lambda w: {out: full_window(F.stddev_samp, F.col("_ret"), w, window)},
        keys=keys,
        back=window + 1,
    )
    return res.drop("_ret")


def _ordered(short: int, long: int) -> None:
    if short >= long:
        raise ValueError(f"short window {short} must be below long window {long}")


def sma_ratio(
    bars: DataFrame, short: int, long: int, out: str = "sma_ratio", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Short over long moving average of the close."""
    _ordered(short, long)
    return over_history(
        bars,
        lambda w: {
            out: ratio(
                full_window(F.avg, F.col(CLOSE), w, short), full_window(F.avg, F.col(CLOSE), w, long)
            )
        },
        keys=keys,
        back=long,
    )


def rolling_vol_ratio(
    bars: DataFrame, short: int, long: int, out: str = "vol_ratio", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Short over long rolling volatility."""
    _ordered(short, long)
    res = over_history(
        bars,
        lambda w: {"_ret": _lagged_return(w, 0)},
        lambda w: {
            out: ratio(
                full_window(F.stddev_samp, F.col("_ret"), w, short),
                full_window(F.stddev_samp, F.col("_ret"), w, long),
            )
        },
        keys=keys,
        back=long + 1,
    )
    return res.drop("_ret")


def _versus_mean(w: WindowSpec, window: int) -> Column:
    mean = full_window(F.avg, F.col(CLOSE), w, window)
    return ratio(F.col(CLOSE) - mean, mean)


def price_vs_mean(
    bars: DataFrame, window: int, out: str = "price_vs_mean", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Distance of the close from its moving average, relative to the average."""
    return over_history(bars, lambda w: {out: _versus_mean(w, window)}, keys=keys, back=window)


def _strength(w: WindowSpec, window: int, saturate: bool) -> Column:
    move = F.col("_move")
    # greatest() ignores NULL, so the first row of a history is kept NULL by hand
    up = F.when(move.isNotNull(), F.greatest(move, F.lit(0.0)))
    down = F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))
    gain, loss = full_window(F.avg, up, w, window), full_window(F.avg, down, w, window)
    value = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio(gain, loss))
    return F.when((loss == 0.0) & (gain > 0.0), F.lit(100.0)).otherwise(value) if saturate else value


def rsi(
    bars: DataFrame,
    window: int = 14,
    out: str = "rsi",
    saturate: bool = False,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Relative strength index from simple means of gains and losses.

    A window without losses gives NULL; ``saturate=True`` gives 100 instead.
    """
    res = over_history(
        bars,
        lambda w: {"_move": F.col(CLOSE) - F.lag(CLOSE).over(w)},
        lambda w: {out: _strength(w, window, saturate)},
        keys=keys,
        back=window + 1,
    )
    return res.drop("_move")


def build_features(
    bars: DataFrame, keys: Sequence[str] = ("symbol",), extra: Sequence[str] = ()
) -> DataFrame:
    """The eleven model features, all from one sort of each symbol's history.

    ``extra`` names further columns to carry along.
    """
    base = bars.select(*dict.fromkeys([*keys, "date", CLOSE, *extra]))
    return over_history(
        base, *feature_stages(), keys=keys, back=21
    ).select(*dict.fromkeys([*keys, "date", CLOSE, *extra]), *FEATURE_COLUMNS)


def feature_stages():
    """Window stages of :func:`build_features`, for operators that add their own stage."""

    def moves(w: WindowSpec) -> dict[str, Column]:
        previous = F.lag(CLOSE, 1).over(w)
        return {
            "return_1d": _lagged_return(w, 0),
            "log_return_1d": F.ln(ratio(F.col(CLOSE), previous)),
            "return_lag1": _lagged_return(w, 1),
            "return_lag2": _lagged_return(w, 2),
            "return_lag3": _lagged_return(w, 3),
            "_move": F.col(CLOSE) - previous,
        }

    def rolled(w: WindowSpec) -> dict[str, Column]:
        close, ret = F.col(CLOSE), F.col("return_1d")
        return {
            "rolling_mean_10": full_window(F.avg, close, w, 10),
            "rolling_vol_10": full_window(F.stddev_samp, ret, w, 10),
            "sma_ratio_5_20": ratio(
                full_window(F.avg, close, w, 5), full_window(F.avg, close, w, 20)
            ),
            "rsi_14": _strength(w, 14, saturate=False),
            "vol_ratio_5_20": ratio(
                full_window(F.stddev_samp, ret, w, 5), full_window(F.stddev_samp, ret, w, 20)
            ),
            "price_vs_mean_20": _versus_mean(w, 20),
        }

    return moves, rolled
