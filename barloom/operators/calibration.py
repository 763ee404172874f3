"""Calibrated probabilities of a model that is fitted on all symbols together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression as MLLogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numbering import numbered
from barloom.session import kept


@dataclass(frozen=True)
class PooledCalibratedLogisticRegression:
    """Pooled logistic regression whose margins are calibrated on held-out inner parts.

    The pooled counterpart of the calibrated history model, so it also suits
    intraday panels: each class is cut into ``cv`` consecutive parts in the order of
    date and symbol, one fit leaves out each part, a curve is fitted to the margins
    of the part left out, and the calibrated values of the ``cv`` fits are averaged.
    """

    C: float = 1.0
    max_iter: int = 200
    method: str = "sigmoid"
    cv: int = 5

    def __post_init__(self) -> None:
        if self.method not in ("sigmoid", "isotonic"):
            raise ValueError("method must be 'sigmoid' or 'isotonic'")
        if self.cv < 2:
            raise ValueError("cv must be at least 2")

    @property
    def min_per_class(self) -> int:
        return self.cv

    def estimator(self, n: int) -> Estimator:
        return CalibratedPool(self)


def inner_parts(rows: DataFrame, cv: int) -> DataFrame:
    """Rows ``(symbol, date, features, label)`` with their ``part``: consecutive shares of each class."""
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    size = F.when(F.col("label") == 1, sizes.get(1.0, 1)).otherwise(sizes.get(0.0, 1))
    placed = numbered(rows, ["label"], [F.col("date"), F.col("symbol")], "_no")
    return placed.withColumn("_n", size).withColumn("part", F.expr(f"int(((_no - 1) * {cv}) div _n)")).drop("_no", "_n")


class CalibratedPool(Estimator):
    """Takes rows ``(symbol, date, features, label)``."""

    def __init__(self, model: PooledCalibratedLogisticRegression):
        super().__init__()
        self.model = model

    def _fit(self, dataset: DataFrame) -> CalibratedPoolModel:
        own = self.model
        parted = inner_parts(dataset.select("symbol", "date", "features", "label"), own.cv)
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(parted)
        rows = kept(scaler.transform(parted).select("part", "features", "scaled", "label"), "calibration-rows")
        counts = {r["part"]: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("ups")).collect()}
        total = sum(c["n"] for c in counts.values())
        spread = [s if s > 0 else 1.0 for s in scaler.std]
        fits = []
        for part in range(own.cv):
            strength = 1.0 / (own.C * max(total - counts[part]["n"], 1))
            learner = MLLogisticRegression(featuresCol="scaled", regParam=strength, standardization=False, maxIter=own.max_iter, tol=1e-7)
            made = learner.fit(rows.filter(F.col("part") != part))
            # the weights of the features before they were scaled
            weights = [float(w / s) if d > 0 else 0.0 for w, s, d in zip(made.coefficients, spread, scaler.std)]
            shift = float(made.intercept - sum(w * m for w, m in zip(weights, scaler.mean)))
            held = rows.filter(F.col("part") == part).select(_dot(weights, shift).alias("margin"), "label")
            ups = float(counts[part]["ups"])
            curve = _sigmoid(held, ups, counts[part]["n"] - ups) if own.method == "sigmoid" else _steps(held)
            fits.append((weights, shift, curve))
        return CalibratedPoolModel(fits, rows)


class CalibratedPoolModel(Model):
    """Mean of the calibrated values of all inner fits, as ``probability``."""

    def __init__(self, fits: list, rows: DataFrame):
        super().__init__()
        self.fits, self.rows = fits, rows

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [f"_p{i}" for i in range(len(self.fits))]
        for name, (weights, shift, curve) in zip(names, self.fits):
            dataset = curve.apply(dataset, _dot(weights, shift), name)
        p = sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)
        return dataset.withColumn("probability", array_to_vector(F.array(1 - p, p))).drop(*names)

    def report(self) -> DataFrame:
        """``(part, n_held, ups_held, total, rising)``: the inner fits on the rows that they left out.

        ``total`` is the sum of a part's calibrated values, which its labels fix if
        the curve is the optimum; ``rising`` tells whether the curve never falls.
        """
        out = None
        for part, (weights, shift, curve) in enumerate(self.fits):
            held = curve.apply(self.rows.filter(F.col("part") == part), _dot(weights, shift), "_p")
            line = held.groupBy("part").agg(
                F.count("*").alias("n_held"), F.sum("label").cast("long").alias("ups_held"), F.sum("_p").alias("total")
            ).withColumn("rising", F.lit(curve.rising))
            out = line if out is None else out.unionByName(line)
        return out


def _dot(weights: list[float], shift: float) -> Column:
    x = vector_to_array("features")
    return sum((x[i] * w for i, w in enumerate(weights)), F.lit(shift))


@dataclass(frozen=True)
class _Sigmoid:
    slope: float
    shift: float

    @property
    def rising(self) -> bool:
        return self.slope >= 0

    def apply(self, rows: DataFrame, margin: Column, out: str) -> DataFrame:
        return rows.withColumn(out, 1 / (1 + F.exp(-(margin * self.slope + self.shift))))


def _sigmoid(held: DataFrame, ups: float, downs: float) -> _Sigmoid:
    """Sigmoid calibration with smoothed labels: each row counts for both classes by its share of them."""
    share = F.when(F.col("label") == 1, (ups + 1) / (ups + 2)).otherwise(1 / (downs + 2))
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), share.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - share).alias("weight"))
    )
    rows = held.select(array_to_vector(F.array("margin")).alias("features"), F.inline(both))
    made = MLLogisticRegression(weightCol="weight", maxIter=200, tol=1e-9).fit(rows)
    return _Sigmoid(float(made.coefficients[0]), float(made.intercept))


@dataclass(frozen=True)
class _Steps:
    model: object

    @property
    def rising(self) -> bool:
        values = list(self.model.predictions)
        return all(a <= b for a, b in zip(values, values[1:]))

    def apply(self, rows: DataFrame, margin: Column, out: str) -> DataFrame:
        placed = rows.withColumn("_margin", margin)
        return self.model.copy().setFeaturesCol("_margin").setPredictionCol(out).transform(placed).drop("_margin")


def _steps(held: DataFrame) -> _Steps:
    """Monotone step fit, linear between the steps; what is broadcast are the ends of the steps."""
    return _Steps(IsotonicRegression(featuresCol="margin", labelCol="label").fit(held))
