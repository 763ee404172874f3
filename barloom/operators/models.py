"""Direction models.

Any object is a model that follows one of three protocols; nothing has to be
derived or registered, and walk-forward, ranking and grid treat all alike:

* a rule has ``probability()`` and ``label()``, column expressions over a row;
* a history model has ``fit_score(x, y, test)``, which gives P(up) of the test
  rows of one symbol from its training rows, as arrays inside a task. A daily
  history has at most ~366 rows a year, which bounds it. ``min_per_class``
  (1 if absent) is how many rows of each class a fit needs;
* a pooled model has ``estimator(n)``, an MLlib estimator for ``n`` training rows
  with the columns ``symbol``, ``date``, ``features`` and ``label``. It is fitted on all symbols
  together, distributed, one fit per fold, so it also suits intraday panels;
* a moment model has ``columns`` and ``solve(n, products, pulls)``, which gives
  weights (the intercept last) from the sums of products of the columns with
  each other and with the target. The sums are Spark aggregates, so it also suits
  intraday panels and no row enters Python.

Models of moments predict a value, as do history models with ``fit_predict(x, y,
test)`` in place of ``fit_score``, and pooled ones with ``regression = True``:
they take the return target. The others predict P(up).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression as MLLogisticRegression
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.operators.features import FEATURE_COLUMNS


@dataclass(frozen=True)
class AlwaysLong:
    """Long every day."""

    def probability(self) -> Column:
        return F.lit(1.0)

    def label(self) -> Column:
        return F.lit(1)


@dataclass(frozen=True)
class PreviousDirection:
    """Repeat the last move: up after a gain, down after a loss or no change."""

    column: str = "return_1d"

    def probability(self) -> Column:
        return self.label().cast("double")

    def label(self) -> Column:
        return (F.col(self.column) > 0).cast("int")


@dataclass(frozen=True)
class ColumnScore:
    """Use an existing column as P(up): scores made elsewhere enter the folds here."""

    column: str

    def probability(self) -> Column:
        return F.col(self.column)

    def label(self) -> Column:
        return (F.col(self.column) > 0.5).cast("int")


def kind_of(model: object) -> str:
    """``rule``, ``history``, ``pooled`` or ``moments``, by the methods a model has."""
    for name, method in (("rule", "probability"), ("pooled", "estimator"), ("moments", "solve"), ("history", "fit_score"), ("history", "fit_predict")):
        if callable(getattr(model, method, None)):
            return name
    raise TypeError(f"{type(model).__name__} has none of probability, estimator, solve, fit_score and fit_predict")


def predicts_values(model: object) -> bool:
    """Whether a model predicts the target itself, not the chance of an up move."""
    kind = kind_of(model)
    if kind == "pooled":
        return bool(getattr(model, "regression", False))
    return kind == "moments" or (kind == "history" and not callable(getattr(model, "fit_score", None)))


def rows_needed(model: object) -> int:
    """Training rows of each class that a fit needs; 0 for rules and for models of values."""
    return 0 if kind_of(model) == "rule" or predicts_values(model) else int(getattr(model, "min_per_class", 1))


# --------------------------------------------------------------------------
# helpers that run inside a task


def standardise(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale both parts by the training rows only."""
    mean, dev = scaling(train)
    return (train - mean) / dev, (test - mean) / dev


def scaling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column; a constant one is not scaled."""
    dev = x.std(axis=0)
    return x.mean(axis=0), np.where(dev < 10 * np.finfo(float).eps, 1.0, dev)


def newton_logistic(
    x: np.ndarray, y: np.ndarray, ridge: np.ndarray, start: np.ndarray, max_iter: int
) -> np.ndarray:
    """Minimise log-loss plus ``ridge . w^2 / 2`` by damped Newton steps.

    ``y`` may hold soft targets in [0, 1]; the problem is convex, so the result
    does not depend on the solver.
    """

    def objective(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0.0, z) - y * z) + 0.5 * np.sum(ridge * w * w))

    w, best = start, objective(start)
    for _ in range(max_iter):
        p = _expit(x @ w)
        grad = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.lstsq(curve, grad, rcond=None)[0]
        size = 1.0
        while size > 1e-8 and objective(w - size * step) > best:
            size /= 2
        w = w - size * step
        value = objective(w)
        if best - value <= 1e-12 * max(1.0, abs(best)) and np.max(np.abs(grad)) < 1e-6:
            break
        best = value
    return w


def _expit(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _with_intercept(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _margin_fit(x: np.ndarray, y: np.ndarray, c: float, max_iter: int) -> np.ndarray:
    wide = _with_intercept(x)
    ridge = np.append(np.full(x.shape[1], 1.0 / c), 0.0)
    return newton_logistic(wide, y, ridge, np.zeros(wide.shape[1]), max_iter)


@dataclass(frozen=True)
class LogisticRegression:
    """L2-penalised logistic regression on standardised features."""

    C: float = 1.0
    max_iter: int = 1000

    def fit_score(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
        x, test = standardise(x, test)
        return _expit(_with_intercept(test) @ _margin_fit(x, y, self.C, self.max_iter))

    def fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Means and deviations of the features, weights and intercept."""
        centre, spread = scaling(x)
        w = _margin_fit((x - centre) / spread, y, self.C, self.max_iter)
        return centre, spread, w[:-1], float(w[-1])


@dataclass(frozen=True)
class CalibratedLogisticRegression:
    """Logistic regression whose margins are calibrated on held-out inner folds.

    The inner folds are stratified and keep the time order; the calibrated
    probabilities of the ``cv`` models are averaged.
    """

    C: float = 1.0
    max_iter: int = 1000
    method: str = "sigmoid"
    cv: int = 5

    @property
    def min_per_class(self) -> int:
        return self.cv

    def __post_init__(self) -> None:
        if self.method not in ("sigmoid", "isotonic"):
            raise ValueError("method must be 'sigmoid' or 'isotonic'")

    def fit_score(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> np.ndarray:
        x, test = standardise(x, test)
        held = stratified_parts(y, self.cv)
        return sum(curve(_with_intercept(test) @ w) for _, w, curve in self.inner_fits(x, y, held)) / self.cv

    def inner_fits(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        """For each part: its rows as flags, the weights fitted to the others, and the curve fitted to its own margins."""
        calibrate = platt_curve if self.method == "sigmoid" else isotonic_curve
        for part in range(self.cv):
            own = held == part
            w = _margin_fit(x[~own], y[~own], self.C, self.max_iter)
            yield own, w, calibrate(_with_intercept(x[own]) @ w, y[own])

    def inner_report(self, x: np.ndarray, y: np.ndarray, test: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
        """Of each part: rows, up rows, sum of their calibrated values, mean calibrated value of ``test``, and whether the curve rises with the margin."""
        x, test = standardise(x, test)
        out = []
        for own, w, curve in self.inner_fits(x, y, stratified_parts(y, self.cv)):
            margins = _with_intercept(x[own]) @ w
            rising = bool(np.all(np.diff(curve(np.sort(margins))) >= -1e-12))
            out.append((int(own.sum()), int(y[own].sum()), float(curve(margins).sum()), float(curve(_with_intercept(test) @ w).mean()), rising))
        return out


def stratified_parts(y: np.ndarray, parts: int) -> np.ndarray:
    """Part number of each row: equal class shares, consecutive rows per class.

    Classes are laid out in the order in which they first appear, and dealt to
    the parts in turn; that gives the number of rows of each class in each part.
    """
    classes = sorted((0.0, 1.0), key=lambda c: int(np.argmax(y == c)))
    laid = np.concatenate([np.full(np.count_nonzero(y == c), i) for i, c in enumerate(classes)])
    out = np.empty(len(y), dtype=int)
    for i, c in enumerate(classes):
        counts = np.bincount(np.flatnonzero(laid == i) % parts, minlength=parts)
        out[y == c] = np.repeat(np.arange(parts), counts)
    return out


def platt_curve(margins: np.ndarray, y: np.ndarray):
    """Sigmoid calibration with smoothed targets."""
    pos = float(np.sum(y > 0))
    neg = len(y) - pos
    soft = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    start = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    slope, shift = newton_logistic(_with_intercept(margins[:, None]), soft, np.zeros(2), start, 200)
    return lambda m: _expit(slope * m + shift)


def isotonic_curve(margins: np.ndarray, y: np.ndarray):
    """Monotone step fit (pooled neighbours), linear between the knots, flat outside."""
    knots, where = np.unique(margins, return_inverse=True)
    weight = np.bincount(where).astype(float)
    value = np.bincount(where, weights=y) / weight
    pools: list[list[float]] = []
    for i, (v, n) in enumerate(zip(value, weight)):
        pools.append([v, n, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, n2, k2 = pools.pop()
            v1, n1, k1 = pools.pop()
            pools.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, k1 + k2])
    fitted = np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])
    return lambda m: np.interp(m, knots, fitted)


@dataclass(frozen=True)
class RandomForest:
    """Bagged shallow trees with a random feature subset at every node, over all symbols."""

    n_estimators: int = 200
    max_depth: int = 5
    min_samples_leaf: int = 20
    seed: int = 42

    def estimator(self, n: int) -> Estimator:
        return RandomForestClassifier(
            numTrees=self.n_estimators, maxDepth=self.max_depth, minInstancesPerNode=self.min_samples_leaf, featureSubsetStrategy="sqrt", seed=self.seed
        )


@dataclass(frozen=True)
class PooledLogisticRegression:
    """L2-penalised logistic regression on standardised features, over all symbols."""

    C: float = 1.0
    max_iter: int = 200

    def estimator(self, n: int) -> Estimator:
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
        learner = MLLogisticRegression(featuresCol="scaled", regParam=1.0 / (self.C * max(n, 1)), standardization=False, maxIter=self.max_iter, tol=1e-7)
        return Pipeline(stages=[scaler, learner])


@dataclass(frozen=True)
class LinearRegression:
    """Least squares on some feature columns, with an intercept that ``ridge`` does not shrink."""

    columns: tuple[str, ...] = tuple(FEATURE_COLUMNS)
    ridge: float = 0.0

    def solve(self, n: int, products: np.ndarray, pulls: np.ndarray) -> np.ndarray:
        """Weights of the columns and the intercept; of all that fit equally well, the smallest."""
        penalty = np.append(np.full(len(self.columns), self.ridge), 0.0)
        # columns of very different size are brought to one scale first
        scale = np.sqrt(np.maximum(np.diag(products), np.finfo(float).tiny))
        return np.linalg.lstsq((products + np.diag(penalty)) / np.outer(scale, scale), pulls / scale, rcond=1e-13)[0] / scale


Model = object
