"""Models, walk-forward, backtest and metrics."""

from __future__ import annotations

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from barloom.operators import experiments, metrics, models, walkforward
from barloom.operators.backtest import run_backtest
from barloom.operators.calibration import PooledCalibratedLogisticRegression
from barloom.operators.splits import WalkForwardSplit
from barloom.operators.targets import make_dataset
from tests.conftest import business_days, column, walk

SPLIT = WalkForwardSplit(n_splits=2, min_train_size=120, test_size=30, gap=1)


def _xy(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 5]
    y = (x[:, 0] + 0.05 * x[:, 1] + rng.normal(size=n) > 0).astype(float)
    return x, y


def test_logistic_reaches_the_optimum():
    x, y = _xy()
    xs, _ = models.standardise(x, x)
    w = models._margin_fit(xs, y, 1.0, 1000)
    wide = np.hstack([xs, np.ones((len(xs), 1))])
    grad = wide.T @ (1 / (1 + np.exp(-wide @ w)) - y) + np.append(w[:-1], 0.0)
    assert np.abs(grad).max() < 1e-6


def test_separable_data_stays_finite():
    x = np.linspace(-1, 1, 60)[:, None]
    p = models.LogisticRegression().fit_score(x, (x[:, 0] > 0).astype(float), x)
    assert np.isfinite(p).all() and (np.diff(p) > 0).all()


def test_scaling_uses_training_rows_only():
    x, y = _xy()
    model = models.LogisticRegression()
    alone = model.fit_score(x[:200], y[:200], x[200:201])
    among = model.fit_score(x[:200], y[:200], np.vstack([x[200:201], x[201:] * 1000]))
    assert alone[0] == pytest.approx(among[0])


def test_inner_parts_are_stratified():
    y = np.array([0.0] * 23 + [1.0] * 37)
    np.random.default_rng(1).shuffle(y)
    parts = models.stratified_parts(y, 5)
    for c in (0.0, 1.0):
        counts = np.bincount(parts[y == c], minlength=5)
        assert counts.max() - counts.min() <= 1
        assert (np.diff(parts[y == c]) >= 0).all()
    # the class that appears first is dealt first, so it gets the larger first parts
    assert models.stratified_parts(np.array([1.0, 0.0, 0.0, 1.0, 1.0]), 2).tolist() == [0, 0, 1, 0, 1]
    assert models.stratified_parts(np.array([0.0, 1.0, 1.0, 0.0, 0.0]), 2).tolist() == [0, 0, 1, 0, 1]


def test_isotonic_is_monotone_least_squares():
    m = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    fit = models.isotonic_curve(m, np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert fit(m) == pytest.approx([0.0, 0.5, 0.5, 1.0, 1.0])
    assert fit(np.array([-9.0, 9.0])) == pytest.approx([0.0, 1.0])


@pytest.mark.parametrize(
    "model",
    [
        models.LogisticRegression(),
        models.CalibratedLogisticRegression(),
        models.CalibratedLogisticRegression(method="isotonic"),
    ],
)
def test_learned_models_predict_and_repeat(model):
    x, y = _xy(600)
    p = model.fit_score(x[:400], y[:400], x[400:])
    assert ((p >= 0) & (p <= 1)).all()
    assert np.mean((p > 0.5) == y[400:]) > 0.65
    assert (p == model.fit_score(x[:400], y[:400], x[400:])).all()


@pytest.mark.parametrize("model", [models.RandomForest(n_estimators=5), models.PooledLogisticRegression()])
def test_pooled_models_learn_from_the_past_of_all_symbols(make_bars, model):
    a, b, cut = walk(240, 8), walk(240, 11), 200
    late = [v * (1.5 if i % 2 else 0.7) for i, v in enumerate(a[cut:])]
    data = [walkforward.run_walk_forward_proba(make_bars({"A": s, "B": b}), model, SPLIT) for s in (a, a[:cut] + late)]
    limit = F.lit(business_days(cut - 2)[-1])
    rows = [sorted(map(tuple, d.collect())) for d in data]
    assert {r[0] for r in rows[0]} == {"A", "B"} and len(rows[0]) == 120 and all(0 <= r[-1] <= 1 for r in rows[0])
    early = [sorted(map(tuple, d.filter(F.col("date") < limit).collect())) for d in data]
    assert early[0] and early[0] == early[1]


def test_pooled_models_take_intraday_panels(make_bars):
    timed = make_bars({"A": walk(240, 9), "B": walk(240, 3)}).withColumn("date", F.col("date").cast("timestamp_ntz"))
    assert walkforward.run_walk_forward(timed, models.PooledLogisticRegression(), SPLIT).count() == 120


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_pooled_calibration_equals_a_plain_one(spark, method):
    """The same parts, fits and curves in numpy, over the rows in order of date and symbol."""
    x, y = _xy(240, 5)
    x = np.hstack([x, np.full((240, 1), 3.0)])  # a feature that never changes
    days = business_days(120)
    rows = [(s, days[i // 2], [float(v) for v in x[i]], float(y[i])) for i, s in enumerate("AB" * 120)]
    frame = spark.createDataFrame(rows, "symbol string, date date, f array<double>, label double")
    frame = frame.select("symbol", "date", array_to_vector("f").alias("features"), "label").repartition(5)
    made = PooledCalibratedLogisticRegression(method=method, cv=4).estimator(240).fit(frame)
    got = {(r["symbol"], r["date"]): r["p"] for r in made.transform(frame).select("symbol", "date", vector_to_array("probability")[1].alias("p")).collect()}

    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0, ddof=1), 1.0)
    part = np.empty(240, int)
    for c in (0.0, 1.0):
        own = np.flatnonzero(y == c)
        part[own] = np.arange(len(own)) * 4 // len(own)
    wanted = np.zeros(240)
    for k in range(4):
        w = models._margin_fit(z[part != k], y[part != k], 1.0, 200)
        margin = models._with_intercept(z) @ w
        curve = (models.platt_curve if method == "sigmoid" else models.isotonic_curve)(margin[part == k], y[part == k])
        wanted += curve(margin) / 4
    seen = np.array([got[s, d] for s, d, _, _ in rows])
    assert seen == pytest.approx(wanted, abs=1e-3 if method == "sigmoid" else 0.02)
    lines = {r["part"]: r for r in made.report().collect()}
    assert [(lines[k]["n_held"], lines[k]["ups_held"]) for k in range(4)] == [((part == k).sum(), y[part == k].sum()) for k in range(4)]
    assert all(r["rising"] for r in lines.values())


def test_pooled_calibration_walks_forward_on_intraday_panels(make_bars):
    timed = make_bars({"A": walk(240, 9), "B": walk(240, 3)}).withColumn("date", F.col("date").cast("timestamp_ntz"))
    scores = walkforward.run_walk_forward_proba(timed, PooledCalibratedLogisticRegression(cv=3), SPLIT).collect()
    assert len(scores) == 120 and all(0 < r["proba_up"] < 1 for r in scores)
    with pytest.raises(ValueError):
        PooledCalibratedLogisticRegression(method="linear")


class MeanReversion:
    """A user's rule: no base class, only the two expressions."""

    def probability(self):
        return F.when(F.col("return_1d") < 0, 0.7).otherwise(0.3)

    def label(self):
        return (F.col("return_1d") < 0).cast("int")


class MajorityVote:
    """A user's history model."""

    def fit_score(self, x, y, test):
        return np.full(len(test), y.mean())


class Shrunken:
    """A user's pooled model."""

    def estimator(self, n):
        return models.PooledLogisticRegression(C=0.01).estimator(n)


@pytest.mark.parametrize("model", [MeanReversion(), MajorityVote(), Shrunken()])
def test_user_models_work_everywhere(make_bars, model):
    from barloom.operators.ranking import rank_universe

    bars = make_bars({"A": walk(420, 5), "B": walk(420, 6)})
    assert walkforward.run_walk_forward(bars, model, SPLIT).count() == 120
    assert rank_universe(bars, model, SPLIT).count() == 2
    period = [{"period": "all", "start": "2020-01-01", "end": "2030-01-01"}]
    grid = experiments.run_grid(bars, period, {"mine": model}, configs=experiments.CONFIGS[:1])
    assert {r["symbol"] for r in grid.collect()} == {"A", "B"}


def test_what_is_no_model_is_refused(make_bars):
    with pytest.raises(TypeError):
        walkforward.run_walk_forward(make_bars({"A": walk(240, 9)}), object(), SPLIT)


def test_one_symbol_never_ends_the_run(make_bars):
    from barloom.operators.ranking import rank_universe, skipped_symbols

    falling = [200 * 0.999**i + (2.5 if i in (50, 80, 100) else 0.02 * (i % 2)) for i in range(260)]
    bars = make_bars({"A": walk(260, 1), "B": walk(260, 2), "DOWN": falling, "NEW": walk(60, 3)})
    model = models.CalibratedLogisticRegression()
    assert {r["symbol"] for r in rank_universe(bars, model, SPLIT).collect()} == {"A", "B"}
    skipped = {r["symbol"]: r["reason"] for r in skipped_symbols(bars, SPLIT, model=model).collect()}
    assert set(skipped) == {"DOWN", "NEW"} and skipped["NEW"] == "too few rows" and "class" in skipped["DOWN"]
    assert {r["symbol"] for r in skipped_symbols(bars, SPLIT).collect()} == {"NEW"}


def test_walk_forward_trains_on_the_past_only(make_bars):
    a = walk(240, 8)
    cut = 200
    b = a[:cut] + [v * (1.5 if i % 2 else 0.7) for i, v in enumerate(a[cut:])]
    data = [
        walkforward.run_walk_forward_proba(make_bars({"A": s}), models.LogisticRegression(), SPLIT) for s in (a, b)
    ]
    limit = F.lit(business_days(cut - 2)[-1])
    early = [sorted(map(tuple, d.filter(F.col("date") < limit).collect())) for d in data]
    assert early[0] and early[0] == early[1]


def test_embargo_covers_the_horizon(make_bars):
    bars = make_bars({"A": walk(260, 9)})
    args = (bars, models.AlwaysLong(), SPLIT, "direction_5d")
    near, far = (
        sorted(r["date"] for r in walkforward.run_walk_forward(*args, embargo=e).collect()) for e in (False, True)
    )
    days = business_days(260)
    assert days.index(far[0]) - days.index(near[0]) == 4


def test_task_code_needs_no_package(tmp_path):
    from pyspark import cloudpickle

    x, y = _xy(80)
    (tmp_path / "model").write_bytes(cloudpickle.dumps((models.CalibratedLogisticRegression(), x, y)))
    code = "import pickle; m, x, y = pickle.load(open('model', 'rb')); print(len(m.fit_score(x, y, x)))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip() == "80", out.stderr


def test_each_test_date_once_and_short_symbols_dropped(make_bars):
    bars = make_bars({"A": walk(240, 9), "B": walk(100, 10)})
    rows = walkforward.run_walk_forward(bars, models.PreviousDirection(), SPLIT).collect()
    assert {r["symbol"] for r in rows} == {"A"} and len({r["date"] for r in rows}) == len(rows) == 60


def test_learned_models_refuse_intraday(make_bars):
    timed = make_bars({"A": walk(240, 9)}).withColumn("date", F.col("date").cast("timestamp_ntz"))
    with pytest.raises(ValueError):
        walkforward.run_walk_forward(timed, models.LogisticRegression(), SPLIT)


def test_models_of_classes_refuse_a_continuous_target(make_bars):
    bars = make_bars({"A": walk(240, 9)})
    with pytest.raises(ValueError):
        walkforward.run_walk_forward(bars, models.LogisticRegression(), SPLIT, "return")
    with pytest.raises(ValueError):
        walkforward.run_walk_forward_proba(bars, models.LinearRegression(), SPLIT)


class LeastSquares:
    """A user's regression on the rows of one history."""

    def fit_predict(self, x, y, test):
        wide = lambda part: np.hstack([part, np.ones((len(part), 1))])
        return wide(test) @ np.linalg.lstsq(wide(x), y, rcond=None)[0]


def test_return_targets_by_moments_equal_a_fit_on_the_rows(make_bars):
    bars = make_bars({"A": walk(240, 9), "B": walk(240, 10), "NEW": walk(60, 3)})
    some = lambda model: {(r["symbol"], r["date"]): r["prediction"] for r in walkforward.run_walk_forward(bars, model, SPLIT, "return").collect()}
    rows, moments = some(LeastSquares()), some(models.LinearRegression())
    assert rows.keys() == moments.keys() and {k[0] for k in rows} == {"A", "B"}
    assert all(moments[k] == pytest.approx(rows[k], abs=1e-6) for k in rows)
    # a large penalty leaves the mean return of the training rows
    flat = some(models.LinearRegression(ridge=1e12))
    assert len({round(v, 9) for (s, _), v in flat.items() if s == "A"}) == SPLIT.n_splits


def test_moment_fits_see_the_past_only(make_bars):
    closes = walk(240, 9)
    cut = lambda c: {(r["fold"]): r["weights"] for r in walkforward.moment_fits(make_dataset(make_bars({"A": c}), "return"), models.LinearRegression(("rsi_14",)), SPLIT).collect()}
    changed = closes[:-3] + [500.0, 1.0, 90.0]
    assert cut(closes)[0] == pytest.approx(cut(changed)[0])
    assert len(cut(closes)) == SPLIT.n_splits


def test_moment_models_take_intraday_panels(make_bars):
    timed = make_bars({"A": walk(240, 9)}).withColumn("date", F.col("date").cast("timestamp_ntz"))
    plain = walkforward.run_walk_forward(make_bars({"A": walk(240, 9)}), models.LinearRegression(), SPLIT, "return")
    got = walkforward.run_walk_forward(timed, models.LinearRegression(), SPLIT, "return")
    assert column(got, "prediction") == pytest.approx(column(plain, "prediction"))


def test_pooled_models_report_the_symbols_without_scores(make_bars):
    from barloom.operators.ranking import skipped_symbols

    splits = WalkForwardSplit(2, 100, 40, 1, anchor="end")
    model = models.PooledLogisticRegression(max_iter=5)
    closes = {"A": walk(240, 9), "B": walk(240, 10)}
    late = business_days(240)[-60:]
    bars = make_bars(closes).unionByName(make_bars({"LATE": walk(60, 5)}, late)).unionByName(make_bars({"GONE": walk(60, 5)}))
    scored = {r["symbol"] for r in walkforward.run_walk_forward_proba(bars, model, splits).select("symbol").distinct().collect()}
    skipped = {r["symbol"]: (r["n"], r["reason"]) for r in skipped_symbols(bars, splits, model=model).collect()}
    # a short history is scored if it has rows on the test dates of its pool
    assert scored == {"A", "B", "LATE"} and skipped == {"GONE": (0, "no row on a test date")}


def test_a_pool_without_one_class_is_reported_with_its_fold(make_bars):
    data = make_dataset(make_bars({"A": walk(240, 9), "B": walk(240, 10)})).withColumn("y", F.lit(1.0))
    model = models.PooledLogisticRegression(max_iter=5)
    assert walkforward.walk_forward_scores(data, model, SPLIT).count() == 0
    found = {(r["symbol"], r["n"], r["reason"]) for r in walkforward.unfit_histories(data, model, SPLIT).collect()}
    assert found == {(s, 0, "one class in fold 0 of its pool") for s in "AB"}
    few = walkforward.unfit_histories(data.limit(50), model, SPLIT).collect()
    assert {r["reason"] for r in few} == {"too few rows in its pool"}


class Counted(models.PooledLogisticRegression):
    """A pooled model that counts its fits."""

    fits: list = []

    def estimator(self, n):
        self.fits.append(n)
        return super().estimator(n)


def test_pools_with_the_same_training_rows_share_a_fit(make_bars):
    data = make_dataset(make_bars({"A": walk(240, 9), "B": walk(240, 10)}))
    keys = ["symbol", "config"]
    both = data.withColumn("config", F.lit("x")).unionByName(data.withColumn("config", F.lit("y")))
    Counted.fits.clear()
    scored = walkforward.walk_forward_scores(both, Counted(max_iter=20), SPLIT, keys)
    assert len(Counted.fits) == SPLIT.n_splits
    parts = [{(r["symbol"], r["date"]): r["proba_up"] for r in scored.filter(F.col("config") == c).collect()} for c in "xy"]
    assert parts[0] == parts[1] and parts[0]
    assert scored.inputFiles()  # results of pooled folds are a table, not a plan


def test_fits_share_the_shuffle_of_the_features(make_bars):
    scores = walkforward.run_walk_forward_proba(make_bars({"A": walk(240, 9)}), models.LogisticRegression(), SPLIT)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_one_class_history_gives_no_rows(make_bars):
    rising = [100.0 * 1.001**i + (0.01 if i % 3 else 0.0) for i in range(240)]
    data = make_dataset(make_bars({"A": rising})).withColumn("y", F.lit(1.0))
    assert walkforward.walk_forward_scores(data, models.LogisticRegression(), SPLIT).count() == 0


# --- backtest --------------------------------------------------------------


def _preds(spark, values, days=None):
    days = days or business_days(len(values))
    return spark.createDataFrame([("A", d, v) for d, v in zip(days, values)], "symbol string, date date, prediction int")


def test_position_lags_the_signal(spark, make_bars):
    bt = run_backtest(_preds(spark, [1, 0, 1, 0]), make_bars({"A": [100.0, 110.0, 121.0, 108.9]}))
    assert column(bt, "position") == [1.0, 0.0, 1.0]
    assert column(bt, "strategy_return") == pytest.approx([0.1, 0.0, -0.1])
    assert column(bt, "cumulative") == pytest.approx([1.1, 1.1, 0.99])


def test_holding_period_and_costs(spark, make_bars):
    flat = make_bars({"A": [100.0] * 7})
    bt = run_backtest(_preds(spark, [0, 1, 0, 0, 0, 1, 0]), flat, costs_bps=10, holding_period=2)
    assert column(bt, "position") == [0.0, 1.0, 1.0, 0.0, 0.0, 1.0]
    assert column(bt, "strategy_return") == pytest.approx([0.0, -0.001, 0.0, -0.001, 0.0, -0.001])
    with pytest.raises(ValueError):
        run_backtest(_preds(spark, [1]), flat, holding_period=0)


def test_first_entry_is_free(spark, make_bars):
    bt = run_backtest(_preds(spark, [1, 1, 1]), make_bars({"A": [100.0] * 3}), costs_bps=10)
    assert column(bt, "strategy_return") == [0.0, 0.0]


def test_missing_prediction_dates_span_bars(spark, make_bars):
    days = business_days(4)
    bt = run_backtest(_preds(spark, [1, 1, 1], [days[0], days[1], days[3]]), make_bars({"A": [100.0, 110.0, 120.0, 132.0]}))
    assert column(bt, "asset_return") == pytest.approx([0.1, 0.2])


def test_whole_backtest_needs_one_shuffle_by_symbol(make_bars):
    bars = make_bars({"A": walk(240, 9)})
    preds = walkforward.run_walk_forward(bars, models.PreviousDirection(), SPLIT)
    report = metrics.return_summary(run_backtest(preds, costs_bps=5.0), {"": ("strategy_return", "position")})
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    joined = metrics.return_summary(run_backtest(preds, bars, 5.0), {"": ("strategy_return", "position")})
    assert tuple(report.first())[1:] == pytest.approx(tuple(joined.first())[1:])


def test_always_long_is_buy_and_hold(spark, make_bars):
    closes = walk(60, 11)
    bars = make_bars({"A": closes})
    for value, wanted in ((1, closes[-1] / closes[0]), (0, 1.0)):
        last = run_backtest(_preds(spark, [value] * 60), bars).orderBy(F.col("date").desc()).first()
        assert last["cumulative"] == pytest.approx(wanted)


# --- metrics ---------------------------------------------------------------


def _returns(spark, values):
    return spark.createDataFrame(
        [("A", d, v, float(i % 2)) for i, (d, v) in enumerate(zip(business_days(len(values)), values))],
        "symbol string, date date, r double, pos double",
    )


def test_return_summary_values(spark):
    values = [0.1, -0.05, 0.02, -0.2]
    row = metrics.return_summary(_returns(spark, values), {"": ("r", "pos")}).first()
    eq = np.cumprod(1 + np.array(values))
    assert row["total_return"] == pytest.approx(eq[-1] - 1)
    assert row["cagr"] == pytest.approx(eq[-1] ** (252 / 4) - 1)
    assert row["volatility"] == pytest.approx(np.std(values, ddof=1) * np.sqrt(252))
    assert row["sharpe"] == pytest.approx(np.mean(values) / np.std(values, ddof=1) * np.sqrt(252))
    assert row["max_drawdown"] == pytest.approx(min(eq / np.maximum.accumulate(eq) - 1))
    assert (row["hit_rate"], row["turnover"]) == (0.5, 1.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_intraday_returns_are_summarised_by_days(spark, seed):
    """Several rows a day, wiped out and turned curves, missing values: equal to one row a day."""
    rng = random.Random(seed)
    rows = []
    for s in "abc":
        for i in range(90):
            r = rng.gauss(0, 0.05) if rng.random() < 0.93 else rng.choice([-1.5, -2.2, None, 0.9])
            rows.append((s, i, r, rng.choice([0.0, 1.0, 1.0, None])))
    frame = spark.createDataFrame(rows, "symbol string, i int, r double, pos double")
    daily = frame.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))
    timed = frame.withColumn("date", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 5 * i)"))
    series = {"": ("r", "pos"), "other_": ("pos", None)}
    a, b = ({r["symbol"]: r.asDict() for r in metrics.return_summary(df, series).collect()} for df in (daily, timed))
    assert a.keys() == b.keys() == set("abc")
    for s in a:
        assert b[s] == pytest.approx(a[s], nan_ok=True)
        assert a[s]["max_drawdown"] < -1
    falls = [{r[0]: r[1] for r in metrics.max_drawdown(df, "r").collect()} for df in (daily, timed)]
    assert falls[0] == pytest.approx(falls[1])


@pytest.mark.parametrize("hold,bps", [(1, 5.0), (3, 0.0)])
def test_sweep_equals_a_backtest_for_each_cut(spark, make_bars, hold, bps):
    rng = random.Random(hold)
    days = business_days(50)
    bars = make_bars({"A": walk(50, 1), "B": [None if i in (7, 8) else v for i, v in enumerate(walk(50, 2))]}, days)
    scores = [(s, d, None if rng.random() < 0.1 else round(rng.random(), 2)) for s in "AB" for d in days]
    rows = bars.join(spark.createDataFrame(scores, "symbol string, date date, proba_up double"), ["symbol", "date"])
    cuts = [0.2, 0.5, 0.9, 2.0]
    sweep = experiments.threshold_sweep(rows, cuts, bps, hold)
    got = {(r["symbol"], r["cut"]): r.asDict() for r in sweep.collect()}
    assert len(got) == 8
    for cut in cuts:
        said = rows.withColumn("prediction", (F.col("proba_up") > cut).cast("int"))
        tests = run_backtest(said, None, bps, hold)
        for r in metrics.return_summary(tests, {"": ("strategy_return", "position")}).collect():
            assert got[r["symbol"], cut] == pytest.approx({**r.asDict(), "cut": cut})
    plan = sweep._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window"), "rows are copied per cut before the window"
    with pytest.raises(ValueError):
        experiments.threshold_sweep(rows, [])


def test_flat_and_single_returns(spark):
    flat = metrics.return_summary(_returns(spark, [0.01] * 5), {"": ("r", None)}).first()
    assert flat["sharpe"] is None and flat["max_drawdown"] == 0.0
    single = metrics.return_summary(_returns(spark, [-0.5]), {"": ("r", "pos")}).first()
    assert (single["max_drawdown"], single["volatility"], single["turnover"]) == (0.0, None, None)


def _labels(spark, truth, guess):
    rows = [("A", d, float(t), g) for d, t, g in zip(business_days(len(truth)), truth, guess)]
    return spark.createDataFrame(rows, "symbol string, date date, y double, prediction int")


def test_class_metrics(spark):
    rows = _labels(spark, [1, 1, 0, 0, 1], [1, 0, 1, 0, 1])
    assert tuple(metrics.confusion_matrix(rows).first())[1:] == (1, 1, 1, 2)
    row = metrics.class_summary(rows).first()
    assert (row["accuracy"], row["precision"], row["recall"]) == pytest.approx((0.6, 2 / 3, 2 / 3))
    none = metrics.class_summary(_labels(spark, [1, 0], [0, 0])).first()
    assert (none["precision"], none["recall"]) == (0.0, 0.0)


def test_report_lists_seen_classes_only(spark):
    rows = {r["label"]: r for r in metrics.classification_report(_labels(spark, [1, 1], [1, 1])).collect()}
    assert set(rows) == {"1", "accuracy", "macro avg", "weighted avg"}
    assert rows["macro avg"]["f1_score"] == 1.0 and rows["1"]["support"] == 2


def test_evaluate_counts_unmatched(spark, make_bars):
    rows = _labels(spark, [1, 0, 1, 1], [1, 0, 1, 0])
    bt = run_backtest(rows, make_bars({"A": [1.0, 2.0, 3.0, 2.0]}))
    metrics.require_aligned(metrics.evaluate(rows, rows, bt))
    report = metrics.evaluate(rows.filter("prediction = 1"), rows, bt)
    assert report.first()["n_unmatched"] == 2 and report.first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        metrics.require_aligned(report)
    with pytest.raises(KeyError):
        metrics.evaluate(rows, rows, bt.drop("position"))


def test_grid_choices(spark):
    rows = spark.createDataFrame(
        [
            ("A", "p", "c1", "AlwaysLong", 0.5),
            ("A", "p", "c2", "Forest", 0.7),
            ("B", "p", "c1", "AlwaysLong", 0.9),
            ("B", "p", "c1", "Forest", 0.2),
            ("C", "p", "c1", "Forest", None),
        ],
        "symbol string, period string, config string, model string, sharpe double",
    )
    best = {r["symbol"]: (r["model"], r["trained_beat"]) for r in experiments.best_per_group(rows).collect()}
    assert best == {"A": ("Forest", True), "B": ("AlwaysLong", False)}
    assert tuple(experiments.beat_count(rows).first()) == (3, 1)
