"""Time-ordered splits: fixed cut dates and expanding walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.history import calendar_bounded, position, running


def train_val_test_split(bars: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """Label rows ``train`` (<= train_end), ``val`` (<= val_end) or ``test``."""
    if train_end >= val_end:
        raise ValueError(f"train_end {train_end} must be before val_end {val_end}")
    return bars.withColumn(
        "split",
        F.when(F.col("date") <= F.lit(train_end).cast("date"), "train")
        .when(F.col("date") <= F.lit(val_end).cast("date"), "val")
        .otherwise("test"),
    )


def require_all_parts(labelled: DataFrame) -> None:
    """Raise when one of the three parts has no row (runs a small aggregate)."""
    counts = {r["split"]: r["n"] for r in labelled.groupBy("split").agg(F.count("*").alias("n")).collect()}
    empty = [p for p in ("train", "val", "test") if not counts.get(p)]
    if empty:
        raise ValueError(f"empty split part(s): {empty}")


@dataclass(frozen=True)
class WalkForwardSplit:
    """Expanding folds: fold ``k`` trains on the first ``min_train_size + k*test_size``
    rows, skips ``gap`` rows and tests on the next ``test_size``.

    ``anchor="start"`` lays the folds from the first row; ``"end"`` moves them so
    that the last test block ends on the last row.
    """

    n_splits: int = 5
    min_train_size: int = 252
    test_size: int = 63
    gap: int = 0
    anchor: str = "start"

    def __post_init__(self) -> None:
        if self.n_splits < 1 or self.min_train_size < 1 or self.test_size < 1:
            raise ValueError("n_splits, min_train_size and test_size must be at least 1")
        if self.gap < 0:
            raise ValueError("gap must not be negative")
        if self.anchor not in ("start", "end"):
            raise ValueError("anchor must be 'start' or 'end'")

    def plan(self, n: Column) -> dict[str, Column]:
        """Per-history fold parameters; ``folds`` is NULL for a history too short."""
        need = self.min_train_size + self.n_splits * self.test_size + self.gap
        slack = n - need if self.anchor == "end" else F.lit(0)
        return {
            "folds": F.when(n >= need, F.lit(self.n_splits)),
            "first_train": (F.lit(self.min_train_size) + slack).cast("int"),
            "test_size": F.lit(self.test_size),
            "gap": F.lit(self.gap),
        }


@dataclass(frozen=True)
class AdaptiveSplit:
    """Folds sized by each history's own length: a short history trains on
    ``short_train`` rows first, a longer one on ``long_train``."""

    test_size: int = 63
    gap: int = 1
    short_train: int = 252
    long_train: int = 504
    long_from: int = 800
    max_splits: int = 8

    def plan(self, n: Column) -> dict[str, Column]:
        first = F.when(n < self.long_from, F.lit(self.short_train)).otherwise(F.lit(self.long_train))
        fitting = F.floor((n - first - self.gap) / F.lit(self.test_size)).cast("int")
        return {
            "folds": F.when(
                n >= first + self.test_size + self.gap, F.least(F.lit(self.max_splits), fitting)
            ),
            "first_train": first,
            "test_size": F.lit(self.test_size),
            "gap": F.lit(self.gap),
        }


Splitter = WalkForwardSplit | AdaptiveSplit
PLAN_COLUMNS = ["folds", "first_train", "test_size", "gap"]


def with_plan(rows: DataFrame, splitter: Splitter, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ``pos`` (position among labelled rows), ``n`` and the fold parameters.

    A row without a label (``y`` NULL) takes the position of the next labelled
    row, so it falls in the test block around it. Histories too short for the
    splitter are left out; :func:`short_histories` lists them.
    """
    labelled = _is_labelled(rows)
    placed = _labelled_position(rows, keys) if "y" in rows.columns else position(rows, keys=keys)
    if calendar_bounded(rows):
        # same partitioning as the history windows: no further shuffle
        sized = placed.withColumn("n", F.count_if(labelled).over(Window.partitionBy(*keys)))
    else:
        sized = placed.join(rows.groupBy(*keys).agg(F.count_if(labelled).alias("n")), list(keys))
    return sized.withColumns(splitter.plan(F.col("n"))).filter("folds is not null")


def _is_labelled(rows: DataFrame) -> Column:
    return F.col("y").isNotNull() if "y" in rows.columns else F.lit(True)


def _labelled_position(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = running(
        rows.withColumn("_lab", F.col("y").isNotNull().cast("int")), {"_seen": ("sum", "_lab")}, keys=keys
    )
    return counted.withColumn("pos", F.col("_seen") - F.col("_lab")).drop("_lab", "_seen")


def short_histories(rows: DataFrame, splitter: Splitter, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Keys whose labelled rows do not fill the folds, with their row count."""
    sizes = rows.groupBy(*keys).agg(F.count_if(_is_labelled(rows)).alias("n"))
    return sizes.withColumns(splitter.plan(F.col("n"))).filter("folds is null").select(*keys, "n")


def out_of_sample(rows: DataFrame) -> DataFrame:
    """Test rows of a planned table with their ``fold``: arithmetic on ``pos`` only."""
    offset = F.col("pos") - F.col("first_train") - F.col("gap")
    fold = F.floor(offset / F.col("test_size")).cast("int")
    return rows.withColumn("fold", fold).filter((F.col("fold") >= 0) & (F.col("fold") < F.col("folds")))


def walk_forward_folds(
    rows: DataFrame, splitter: Splitter, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Every ``(row, fold, role)`` of the walk-forward plan.

    A training row belongs to all folds from the first one whose training part
    reaches it; that run of folds is exploded, so there is no join on a range.
    """
    planned = with_plan(rows.select(*keys, "date", *(["y"] if "y" in rows.columns else [])), splitter, keys)
    test = out_of_sample(planned).withColumn("role", F.lit("test"))
    first = F.when(F.col("pos") < F.col("first_train"), F.lit(0)).otherwise(
        (F.floor((F.col("pos") - F.col("first_train")) / F.col("test_size")) + 1).cast("int")
    )
    train = (
        planned.withColumn("_first", first)
        .filter(F.col("_first") < F.col("folds"))
        .withColumn("fold", F.explode(F.sequence("_first", F.col("folds") - 1)))
        .withColumn("role", F.lit("train"))
    )
    cols = [*keys, "date", "pos", "fold", "role"]
    return train.select(cols).unionByName(test.select(cols))
