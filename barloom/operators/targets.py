"""Forward-looking targets and the labelled training set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.exprs import change
from barloom.functions.history import over_history
from barloom.operators.features import CLOSE, FEATURE_COLUMNS, feature_stages

# Accepted target names and how many rows each looks ahead.
TARGET_HORIZON = {"direction": 1, "return": 1, "direction_5d": 5, "threshold": 1}
THRESHOLD = 0.005


def target_column(w: WindowSpec, target: str, threshold: float = THRESHOLD) -> Column:
    """The target as a window expression over one history."""
    if target not in TARGET_HORIZON:
        raise ValueError(f"target must be one of {sorted(TARGET_HORIZON)}, got {target!r}")
    ahead = F.lead(CLOSE, TARGET_HORIZON[target]).over(w)
    close = F.col(CLOSE)
    if target in ("direction", "direction_5d"):
        return (ahead > close).cast("double")
    forward = change(ahead, close)
    if target == "return":
        return forward
    return F.when(forward > threshold, F.lit(1.0)).when(forward < -threshold, F.lit(0.0))


def _with_target(bars: DataFrame, target: str, out: str, keys: Sequence[str], **kw) -> DataFrame:
    return over_history(
        bars, lambda w: {out: target_column(w, target, **kw)}, keys=keys, ahead=TARGET_HORIZON[target]
    )


def next_day_direction(bars: DataFrame, out: str = "target_direction", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """1 when the next close is higher, 0 when not, NULL on the last row."""
    return _with_target(bars, "direction", out, keys)


def next_day_return(bars: DataFrame, out: str = "target_return", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Return of the next row."""
    return _with_target(bars, "return", out, keys)


def next_5day_direction(bars: DataFrame, out: str = "target_direction_5d", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """1 when the close five rows on is higher; NULL on the last five rows."""
    return _with_target(bars, "direction_5d", out, keys)


def threshold_direction(
    bars: DataFrame,
    threshold: float = THRESHOLD,
    out: str = "target_threshold",
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """1 / 0 for a next-row move beyond the threshold, NULL for a neutral one."""
    return _with_target(bars, "threshold", out, keys, threshold=threshold)


def make_dataset(
    bars: DataFrame,
    target: str = "direction",
    keys: Sequence[str] = ("symbol",),
    *,
    keep_unlabelled: bool = False,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Features plus target ``y``; rows with a missing value are dropped.

    ``keep_unlabelled`` keeps rows whose features are complete but whose target
    is NULL, so that a model can score them (they never train it). Features and
    target share one shuffle and one sort.
    """
    if target not in TARGET_HORIZON:
        raise ValueError(f"target must be one of {sorted(TARGET_HORIZON)}, got {target!r}")
    base = bars.select(*keys, "date", CLOSE)
    full = over_history(
        base,
        *feature_stages(),
        lambda w: {"y": target_column(w, target, threshold)},
        keys=keys,
        back=21,
        ahead=TARGET_HORIZON[target],
    )
    needed = FEATURE_COLUMNS if keep_unlabelled else [*FEATURE_COLUMNS, "y"]
    return full.select(*keys, "date", CLOSE, *FEATURE_COLUMNS, "y").na.drop(subset=needed)
