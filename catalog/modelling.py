"""Models, walk-forward runs, backtests, metrics and the experiment grid."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import experiments as ex
from barloom.operators import metrics as me
from barloom.operators import models as mo
from barloom.operators import walkforward as wf
from barloom.operators.backtest import run_backtest
from barloom.operators.calibration import PooledCalibratedLogisticRegression
from barloom.operators.features import FEATURE_COLUMNS, build_features
from barloom.operators.replay import strategy_curves
from barloom.operators.splits import walk_forward_folds
from barloom.operators.targets import make_dataset
from barloom.plans import inputs
from barloom.plans.report import rule_report
from barloom.session import kept
import catalog.panel  # noqa: F401  (defines the feature and dataset tables)
from catalog.base import SYM, backtest_sql, complete, features_sql, query, sql_table, summary_sql

def _panel(spark, sf):
    """Bars written once, for queries that read them more than once."""
    return kept(inputs.bars(spark, sf), "bars")


# --- rule models -----------------------------------------------------------

MODEL = "symbol:t date:d prediction:i proba_up:8"


def _rule(model):
    def run(spark, sf):
        return build_features(inputs.bars(spark, sf)).filter("return_1d is not null").select(
            "symbol", "date", model.label().alias("prediction"), model.probability().alias("proba_up")
        )

    return run


query(
    "f1_always_long",
    MODEL,
    _rule(mo.AlwaysLong()),
    "SELECT symbol, date, 1 AS prediction, 1.0 AS proba_up FROM feats WHERE return_1d IS NOT NULL",
)
query(
    "f2_previous_direction",
    MODEL,
    _rule(mo.PreviousDirection()),
    """SELECT symbol, date, CAST(return_1d > 0 AS INTEGER) AS prediction, CAST(return_1d > 0 AS DOUBLE) AS proba_up
       FROM feats WHERE return_1d IS NOT NULL""",
)

# --- walk-forward ----------------------------------------------------------


def _folded(ds: str, extra: str = "") -> str:
    """SQL of the test rows of 5 folds (252 first, 63 each, gap 1) over a dataset."""
    return f"""SELECT symbol, date, (pos - 253) // 63 AS fold, return_1d, y{extra} FROM (
        SELECT *, row_number() OVER ({SYM}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM {ds})
        WHERE n >= 252 + 5 * 63 + 1 AND pos >= 253 AND pos < 253 + 5 * 63"""


for _t in ("direction", "threshold"):
    sql_table(
        f"wf_{_t}",
        f"SELECT *, CAST(return_1d > 0 AS INTEGER) AS prediction, CAST(return_1d > 0 AS DOUBLE) AS proba_up "
        f"FROM ({_folded(f'ds_{_t}')})",
    )
    query(
        f"g1_walk_forward_rule_{_t}",
        "symbol:t date:d fold:i prediction:i",
        lambda spark, sf, t=_t: wf.run_walk_forward(
            inputs.bars(spark, sf), mo.PreviousDirection(), inputs.SPLITTER, t
        ),
        f"SELECT * FROM wf_{_t}",
    )

# all rows with features; a row takes the position of the next labelled row
sql_table(
    "neutral_rows",
    f"""SELECT symbol, date, fold, prediction FROM (
      SELECT *, (pos - 253) // 63 AS fold, CAST(return_1d > 0 AS INTEGER) AS prediction FROM (
        SELECT *, sum(lab) OVER ({SYM} ROWS UNBOUNDED PRECEDING) - lab AS pos, sum(lab) OVER (PARTITION BY symbol) AS n
        FROM (SELECT f.*, CASE WHEN t.y IS NULL THEN 0 ELSE 1 END AS lab
              FROM feats f LEFT JOIN ds_threshold t USING (symbol, date) WHERE {complete(['f.' + c for c in FEATURE_COLUMNS])})))
      WHERE n >= 568 AND pos >= 253 AND fold < 5""",
)
query(
    "g1_walk_forward_score_neutral",
    "symbol:t date:d fold:i prediction:i",
    lambda spark, sf: wf.run_walk_forward(
        inputs.bars(spark, sf), mo.PreviousDirection(), inputs.SPLITTER, "threshold", score_neutral=True
    ),
    "SELECT * FROM neutral_rows",
)
query(
    "g2_walk_forward_proba_rule",
    "symbol:t date:d fold:i proba_up:8",
    lambda spark, sf: wf.run_walk_forward_proba(
        inputs.bars(spark, sf), mo.PreviousDirection(), inputs.SPLITTER
    ),
    "SELECT * FROM wf_direction",
)

# regression of the next return on two moving features, by the moments of the training rows
sql_table("wf_return_train", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM ds_return")
sql_table(
    "return_line",
    """SELECT symbol, fold, count(*) AS n, regr_slope(y, price_vs_mean_20) AS slope, regr_intercept(y, price_vs_mean_20) AS intercept
       FROM wf_return_train JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) ON pos < 252 + fold * 63 WHERE n >= 568 GROUP BY symbol, fold""",
)
# two columns: the normal equations of the centred sums, by Cramer's rule
sql_table(
    "return_plane",
    """SELECT symbol, fold, n, wa, wb, my - wa * ma - wb * mb AS w0 FROM (
         SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS wa, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS wb FROM (
           SELECT symbol, fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(a, a) AS saa, regr_sxx(b, b) AS sbb,
             regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby
           FROM (SELECT *, return_1d AS a, rsi_14 AS b FROM wf_return_train) JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) ON pos < 252 + fold * 63
           WHERE n >= 568 GROUP BY symbol, fold))""",
)
query(
    "g1_walk_forward_return",
    "symbol:t date:d fold:i prediction:10",
    lambda spark, sf: wf.run_walk_forward(inputs.bars(spark, sf), mo.LinearRegression(("price_vs_mean_20",)), inputs.SPLITTER, "return"),
    f"""SELECT symbol, date, fold, slope * price_vs_mean_20 + intercept AS prediction
        FROM (SELECT *, (pos - 253) // 63 AS fold FROM wf_return_train WHERE n >= 568 AND pos >= 253 AND pos < 253 + 5 * 63) JOIN return_line USING (symbol, fold)""",
)


def _return_fits(spark, sf):
    data = make_dataset(inputs.bars(spark, sf), "return")
    fits = wf.moment_fits(data, mo.LinearRegression(("return_1d", "rsi_14")), inputs.SPLITTER)
    return fits.select("symbol", "fold", "n", *(F.col("weights")[i].alias(c) for i, c in enumerate(("wa", "wb", "w0"))))


query("g1_return_fits", "symbol:t fold:i n:l wa:8 wb:10 w0:8", _return_fits, "SELECT symbol, fold, n, wa, wb, w0 FROM return_plane")

# a smoother rule probability, for thresholds: how RSI stands within 0..100
sql_table("wf_rsi", _folded("ds_direction", ", rsi_14 / 100 AS proba_up"))


def _rsi_scores(panel):
    data = make_dataset(panel).withColumn("rsi_score", F.col("rsi_14") / 100)
    return wf.walk_forward_scores(data, mo.ColumnScore("rsi_score"), inputs.SPLITTER)


query(
    "g3_probability_threshold",
    "symbol:t date:d proba_up:8 prediction:i",
    lambda spark, sf: wf.threshold_signal(_rsi_scores(inputs.bars(spark, sf)), 0.55),
    "SELECT *, CAST(proba_up > 0.55 AS INTEGER) AS prediction FROM wf_rsi",
)
query(
    "g3_long_share",
    "symbol:t long_pct:8",
    lambda spark, sf: wf.long_share(_rsi_scores(inputs.bars(spark, sf)), 0.55),
    "SELECT symbol, 100 * avg(CASE WHEN proba_up > 0.55 THEN 1.0 ELSE 0.0 END) AS long_pct FROM wf_rsi GROUP BY symbol",
)

_CUTS = [0.50, 0.55, 0.60, 0.65]
sql_table(
    "swept",
    f"SELECT symbol, cut, date, CAST(proba_up > cut AS INTEGER) AS prediction "
    f"FROM wf_rsi, (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in _CUTS)}]) AS cut)",
)
sql_table("swept_bt", backtest_sql("swept", "symbol, cut", 5.0))
SUMMARY = "total_return:6 cagr:6 volatility:8 sharpe:6 max_drawdown:6 hit_rate:8 turnover:8"
query(
    "g4_threshold_sweep",
    f"symbol:t cut:2 {SUMMARY}",
    lambda spark, sf: ex.threshold_sweep(_rsi_scores(inputs.bars(spark, sf)), _CUTS),
    summary_sql("swept_bt", "strategy_return", "symbol, cut", "position"),
)

# --- learned models --------------------------------------------

# (symbol, fold) with its training rows, and what any optimum with a free intercept has: as many expected as actual ups
sql_table(
    "fold_rows",
    f"""SELECT symbol, fold, pos, y FROM (SELECT *, row_number() OVER ({SYM}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM ds_direction)
        JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) ON pos < 252 + fold * 63 WHERE n >= 568""",
)


def _logistic(spark, sf):
    """Per fold: expected ups of the training rows by the reported fit, and whether it gives the scores of the test rows."""
    data = kept(make_dataset(inputs.bars(spark, sf)), "dataset")
    model = mo.LogisticRegression()
    fits = kept(wf.logistic_fits(data, model, inputs.SPLITTER), "fits").drop("n")
    scored = wf.walk_forward_scores(data, model, inputs.SPLITTER).select("symbol", "date", "fold", "proba_up")
    roles = walk_forward_folds(data, inputs.SPLITTER).select("symbol", "date", "fold", "role")
    rows = roles.join(data.select("symbol", "date", *FEATURE_COLUMNS), ["symbol", "date"]).join(fits, ["symbol", "fold"]).join(scored, ["symbol", "date", "fold"], "left")
    terms = [(F.col(c) - F.col("centre")[i]) / F.col("spread")[i] * F.col("weights")[i] for i, c in enumerate(FEATURE_COLUMNS)]
    p = 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + F.col("intercept"))))
    test = F.col("role") == "test"
    return rows.withColumn("p", p).groupBy("symbol", "fold").agg(
        F.sum(F.when(~test, F.col("p"))).alias("expected_ups"), F.count_if(test & (F.abs(F.col("p") - F.col("proba_up")) < 1e-9)).alias("n_test")
    )


query(
    "f3_logistic_regression",
    "symbol:t fold:i expected_ups:4 n_test:l",
    _logistic,
    "SELECT symbol, fold, sum(y) AS expected_ups, 63 AS n_test FROM fold_rows GROUP BY symbol, fold",
)

# rows of the inner parts: each class is laid out after the other, the class of the first row first, and dealt to the parts in turn
sql_table(
    "inner_parts",
    """SELECT symbol, fold, part, sum(held) AS n_held, sum(CASE WHEN y = 1 THEN held ELSE 0 END) AS ups_held FROM (
         SELECT *, (o + n - part + 4) // 5 - (o - part + 4) // 5 AS held FROM (
           SELECT c.symbol, c.fold, c.y, c.n, CASE WHEN c.y = f.first THEN 0 ELSE f.n_first END AS o FROM
             (SELECT symbol, fold, y, count(*) AS n FROM fold_rows GROUP BY ALL) c JOIN
             (SELECT symbol, fold, first, count(*) FILTER (WHERE y = first) AS n_first FROM
               (SELECT *, first_value(y) OVER (PARTITION BY symbol, fold ORDER BY pos) AS first FROM fold_rows) GROUP BY ALL) f USING (symbol, fold))
         JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS part) ON true) GROUP BY symbol, fold, part""",
)


def _calibrated(model):
    def run(spark, sf):
        data = kept(make_dataset(wf.by_history(inputs.bars(spark, sf))), "dataset")
        parts = wf.calibration_report(data, model, inputs.SPLITTER)
        scores = wf.walk_forward_scores(data, model, inputs.SPLITTER).groupBy("symbol", "fold").agg(F.count("*").alias("n_test"), F.avg("proba_up").alias("mean"))
        means = Window.partitionBy("symbol", "fold")
        agrees = F.abs(F.avg("test_mean").over(means) - F.col("mean")) < 1e-9
        return parts.join(scores, ["symbol", "fold"]).select("symbol", "fold", "part", "n_held", "ups_held", "total", "rising", "n_test", agrees.alias("agrees"))

    return run


_PARTS = "symbol:t fold:i part:i n_held:l ups_held:l total:6 rising:b n_test:l agrees:b"
_PARTS_SQL = "SELECT symbol, fold, part, n_held, ups_held, {} AS total, true AS rising, 63 AS n_test, true AS agrees FROM inner_parts"
query(
    "f4_calibrated_sigmoid",
    _PARTS,
    _calibrated(mo.CalibratedLogisticRegression()),
    # the curve is fitted to smoothed labels, and has their sum
    _PARTS_SQL.format("ups_held * (ups_held + 1.0) / (ups_held + 2) + (n_held - ups_held) / (n_held - ups_held + 2.0)"),
)
query("f4_calibrated_isotonic", _PARTS, _calibrated(mo.CalibratedLogisticRegression(method="isotonic")), _PARTS_SQL.format("CAST(ups_held AS DOUBLE)"))


def _pooled_calibration(method):
    """The inner parts of one calibrated fit to all rows of all symbols."""

    def run(spark, sf):
        data = kept(make_dataset(inputs.bars(spark, sf)), "dataset")
        rows = data.select("symbol", "date", array_to_vector(F.array(*FEATURE_COLUMNS)).alias("features"), F.col("y").cast("double").alias("label"))
        return PooledCalibratedLogisticRegression(method=method).estimator(rows.count()).fit(rows).report()

    return run


_POOLED_PARTS_SQL = """SELECT part, count(*) AS n_held, CAST(sum(y) AS BIGINT) AS ups_held, {} AS total, true AS rising FROM (
    SELECT y, CAST((row_number() OVER (PARTITION BY y ORDER BY date, symbol) - 1) * 5 // count(*) OVER (PARTITION BY y) AS INTEGER) AS part FROM ds_direction)
    GROUP BY part"""
_POOLED_PARTS = "part:i n_held:l ups_held:l total:{} rising:b"
query(
    "f4_pooled_calibrated_sigmoid",
    _POOLED_PARTS.format(3),
    _pooled_calibration("sigmoid"),
    _POOLED_PARTS_SQL.format("sum(y) * (sum(y) + 1.0) / (sum(y) + 2) + (count(*) - sum(y)) / (count(*) - sum(y) + 2.0)"),
)
query("f4_pooled_calibrated_isotonic", _POOLED_PARTS.format(6), _pooled_calibration("isotonic"), _POOLED_PARTS_SQL.format("CAST(sum(y) AS DOUBLE)"))


def _fits(spark, sf):
    """Fits of every fold, with the scaling they used and whether they are at the optimum."""
    data = kept(make_dataset(inputs.bars(spark, sf)), "dataset")
    fits = kept(wf.logistic_fits(data, mo.LogisticRegression(), inputs.SPLITTER), "fits")
    slopes = wf.steepest_descent(data, fits, inputs.SPLITTER)
    each = [F.col(f"{part}")[i].alias(f"{part}_{name}") for i, name in enumerate(FEATURE_COLUMNS) for part in ("centre", "spread")]
    return fits.join(slopes, ["symbol", "fold"]).select("symbol", "fold", "n", *each, (F.col("gradient") < 1e-5).alias("optimal"))


query(
    "f3_logistic_fits",
    "symbol:t fold:i n:l " + " ".join(f"centre_{c}:6 spread_{c}:6" for c in FEATURE_COLUMNS) + " optimal:b",
    _fits,
    "SELECT symbol, fold, count(*) AS n, true AS optimal, "
    + ", ".join(f"avg({c}) AS centre_{c}, stddev_pop({c}) AS spread_{c}" for c in FEATURE_COLUMNS)
    + f""" FROM (SELECT *, row_number() OVER ({SYM}) - 1 AS pos FROM ds_direction) JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold)
        ON pos < 252 + fold * 63 GROUP BY symbol, fold""",
)

# pooled models: folds cut on the dates of all symbols together
for _target in ("direction", "threshold"):
    sql_table(
        f"pooled_{_target}",
        f"""SELECT symbol, d.date, pos, y FROM ds_{_target} d JOIN (
              SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ds_{_target})) a
            ON a.date = d.date WHERE n >= 568""",
    )
_POOLED_SQL = """SELECT fold, count(*) FILTER (WHERE pos < 252 + fold * 63) AS n_train, {} AS {},
    count(*) FILTER (WHERE pos >= 253 + fold * 63 AND pos < 316 + fold * 63) AS n_test{} FROM pooled_{} JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) ON true GROUP BY fold"""
_TRAIN_UPS = "sum(CASE WHEN pos < 252 + fold * 63 THEN y ELSE 0 END)"


def _pooled(model, target):
    """Scores of the training rows and of the test rows, by fold."""

    def run(spark, sf):
        data = kept(make_dataset(inputs.bars(spark, sf), target), "dataset")
        tests = wf.walk_forward_scores(data, model, inputs.SPLITTER).groupBy("fold").agg(F.count_if(F.col("proba_up").between(0.0, 1.0)).alias("n_test"))
        p, y = F.col("proba_up"), F.col("y")
        error = F.avg(F.pow(p - y, F.lit(2.0)))
        train = wf.training_scores(data, model, inputs.SPLITTER).groupBy("fold").agg(
            F.count("*").alias("n_train"), F.sum(p).alias("expected_ups"), F.sum(y).alias("ups"),
            (F.abs(F.avg(p) - F.avg(y)) < 0.02).alias("centred"), (error < 0.97 * F.var_pop(y)).alias("learned"), F.count_distinct(F.round(p, 6)).alias("levels"),
        )
        return train.join(tests, "fold")

    return run


query(
    "f3_pooled_logistic",
    "fold:i n_train:l expected_ups:2 n_test:l",
    lambda spark, sf: _pooled(mo.PooledLogisticRegression(), "direction")(spark, sf).select("fold", "n_train", "expected_ups", "n_test"),
    _POOLED_SQL.format(_TRAIN_UPS, "expected_ups", "", "direction"),
)
query(
    "f5_random_forest",
    "fold:i n_train:l ups:1 n_test:l centred:b learned:b many_levels:b",
    # no constant and no random score is centred and better than the base rate on every fold's rows
    lambda spark, sf: _pooled(mo.RandomForest(), "threshold")(spark, sf).select("fold", "n_train", "ups", "n_test", "centred", "learned", (F.col("levels") > 100).alias("many_levels")),
    _POOLED_SQL.format(_TRAIN_UPS, "ups", ", true AS centred, true AS learned, true AS many_levels", "threshold"),
)

# --- backtests -------------------------------------------------------------

BT = "symbol:t date:d close:8 asset_return:8 prediction:1 position:1 strategy_return:8 cumulative:6 buy_and_hold:6"


def _bt(target, costs, hold, joined=False):
    """Backtest of the rule; ``joined`` takes the closes from the bars again."""

    def run(spark, sf):
        panel = _panel(spark, sf) if joined else inputs.bars(spark, sf)
        preds = wf.run_walk_forward(panel, mo.PreviousDirection(), inputs.SPLITTER, target)
        return run_backtest(preds, panel if joined else None, costs, hold)

    return run


for _name, _t, _costs, _hold in (
    ("h1_backtest_hp1", "direction", 0.0, 1),
    ("h1_backtest_hp1_costs", "direction", 5.0, 1),
    ("h1_backtest_hp5_costs", "direction", 5.0, 5),
    ("h1_backtest_threshold_gaps", "threshold", 5.0, 1),
):
    sql_table(_name[3:] + "_t", backtest_sql(f"wf_{_t}", costs=_costs, hold=str(_hold), choices=(_hold,)))
    query(_name, BT, _bt(_t, _costs, _hold, joined=_costs == 0.0), f"SELECT * FROM {_name[3:]}_t")

# --- return metrics --------------------------------------------------------

_COSTS = _bt("direction", 5.0, 1)
_SRC = "backtest_hp1_costs_t"


def _metric(name: str, col: str, run, digits: int = 6) -> None:
    query(
        name,
        f"symbol:t {col}:{digits}",
        lambda spark, sf: run(_COSTS(spark, sf)),
        f"SELECT symbol, {col} FROM ({summary_sql(_SRC, 'strategy_return', pos='position', rf=0.02)})",
    )


def _agg(expr, col):
    return lambda bt: bt.groupBy("symbol").agg(expr(F.col("strategy_return")).alias(col))


_metric("i1_total_return", "total_return", _agg(me.total_return, "total_return"))
_metric("i2_cagr", "cagr", _agg(me.cagr, "cagr"))
_metric("i3_volatility", "volatility", _agg(me.volatility, "volatility"), 8)
_metric("i4_sharpe", "sharpe", _agg(lambda r: me.sharpe(r, 0.02), "sharpe"))
_metric("i5_max_drawdown", "max_drawdown", lambda bt: me.max_drawdown(bt, "strategy_return"))
_metric("i6_hit_rate", "hit_rate", _agg(me.hit_rate, "hit_rate"), 8)
_metric("i7_turnover", "turnover", lambda bt: me.turnover(bt, "position"), 8)
query(
    "i8_return_summary",
    f"symbol:t {SUMMARY}",
    lambda spark, sf: me.return_summary(
        _COSTS(spark, sf), {"": ("strategy_return", "position")}, risk_free=0.02
    ),
    summary_sql(_SRC, "strategy_return", pos="position", rf=0.02),
)
query(
    "i8_rule_report",
    f"symbol:t {SUMMARY}",
    lambda spark, sf: rule_report(spark, sf, inputs.SPLITTER),
    summary_sql(_SRC, "strategy_return", pos="position"),
)

# --- classification metrics ------------------------------------------------


def _labelled(spark, sf):
    data = make_dataset(inputs.bars(spark, sf))
    return wf.walk_forward_scores(data, mo.PreviousDirection(), inputs.SPLITTER)


_CELLS = """SELECT symbol, count(*) AS n, count(*) FILTER (WHERE y = 0 AND prediction = 0) AS tn,
    count(*) FILTER (WHERE y = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE y = 1 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE y = 1 AND prediction = 1) AS tp FROM wf_direction GROUP BY symbol"""
sql_table("cells", _CELLS)
sql_table(
    "class_scores",
    """SELECT symbol, (tn + tp) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM cells""",
)
query(
    "i9_accuracy_precision_recall",
    "symbol:t accuracy:8 precision:8 recall:8",
    lambda spark, sf: me.class_summary(_labelled(spark, sf)),
    "SELECT * FROM class_scores",
)
query(
    "i10_confusion_matrix",
    "symbol:t tn:l fp:l fn:l tp:l",
    lambda spark, sf: me.confusion_matrix(_labelled(spark, sf)),
    "SELECT * FROM cells",
)
query(
    "i11_classification_report",
    "symbol:t label:t precision:8 recall:8 f1_score:8 support:l",
    lambda spark, sf: me.classification_report(_labelled(spark, sf)),
    """WITH c AS (SELECT symbol, n, (tn + tp) / n AS acc, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tn + fp AS s0,
           2 * tn / (2 * tn + fn + fp) AS f0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tp + fn AS s1,
           2 * tp / (2 * tp + fn + fp) AS f1 FROM cells)
       SELECT symbol, '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM c
       UNION ALL SELECT symbol, '1', p1, r1, f1, s1 FROM c
       UNION ALL SELECT symbol, 'accuracy', NULL, NULL, acc, n FROM c
       UNION ALL SELECT symbol, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM c
       UNION ALL SELECT symbol, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
         (f0 * s0 + f1 * s1) / n, n FROM c""",
)
query(
    "i12_class_summary_pooled",
    "fold:i accuracy:8 precision:8 recall:8",
    lambda spark, sf: me.class_summary(_labelled(spark, sf), keys=["fold"]),
    """SELECT fold, avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
         coalesce(sum(y * prediction) / nullif(sum(prediction), 0), 0) AS precision,
         coalesce(sum(y * prediction) / nullif(sum(y), 0), 0) AS recall FROM wf_direction GROUP BY fold""",
)


def _evaluate(spark, sf):
    data = make_dataset(inputs.bars(spark, sf))
    rows = kept(wf.walk_forward_scores(data, mo.PreviousDirection(), inputs.SPLITTER), "predictions")
    return me.evaluate(rows, rows, run_backtest(rows, None, 5.0))


_BOTH = " ".join(f"strategy_{w}" for w in SUMMARY.split()) + " " + " ".join(
    f"buy_and_hold_{w}" for w in SUMMARY.split()[:-1]
)
query(
    "i13_evaluate",
    f"symbol:t accuracy:8 precision:8 recall:8 n_unmatched:l {_BOTH}",
    _evaluate,
    f"""SELECT *, 0 AS n_unmatched FROM class_scores
        JOIN ({summary_sql(_SRC, 'strategy_return', pos='position', prefix='strategy_')}) USING (symbol)
        JOIN ({summary_sql(_SRC, 'asset_return', prefix='buy_and_hold_')}) USING (symbol)""",
)

# --- experiment grid -------------------------------------------------------

PERIODS = [
    {"period": "1995-1997", "start": "1995-01-01", "end": "1997-12-31"},
    {"period": "1998-2001", "start": "1998-01-01", "end": "2001-12-31"},
    {"period": "1995-2001", "start": "1995-01-01", "end": "2001-12-31"},
]
RULES = {"AlwaysLong": mo.AlwaysLong(), "PreviousDirection": mo.PreviousDirection()}
_P = "symbol, period"
_PW = f"PARTITION BY {_P} ORDER BY date"
_UP = f"lead(close) OVER ({_PW}) / close - 1"
sql_table(
    "grid_bars",
    "SELECT b.*, period FROM bars b JOIN (VALUES "
    + ", ".join(f"('{p['period']}', DATE '{p['start']}', DATE '{p['end']}')" for p in PERIODS)
    + ") v(period, lo, hi) ON date BETWEEN lo AND hi",
)
sql_table("grid_feats", features_sql("grid_bars", _P))
sql_table(
    "grid_y",
    f"""SELECT *, CAST(lead(close) OVER ({_PW}) > close AS DOUBLE) AS y1,
        CAST(lead(close, 5) OVER ({_PW}) > close AS DOUBLE) AS y5,
        CASE WHEN {_UP} > 0.005 THEN 1.0 WHEN {_UP} < -0.005 THEN 0.0 END AS yt FROM grid_feats""",
)
sql_table(
    "grid_ds",
    f"""SELECT * FROM (
      SELECT symbol, period, 'dir/hp1' AS config, 1 AS hold, date, close, return_1d, y1 AS y FROM grid_y WHERE {complete(FEATURE_COLUMNS)}
      UNION ALL SELECT symbol, period, '5d/hp5', 5, date, close, return_1d, y5 FROM grid_y WHERE {complete(FEATURE_COLUMNS)}
      UNION ALL SELECT symbol, period, 'thr/hp1', 1, date, close, return_1d, yt FROM grid_y WHERE {complete(FEATURE_COLUMNS)})
      WHERE y IS NOT NULL""",
)
sql_table(
    "grid_test",
    """SELECT * FROM (
      SELECT *, (pos - first - 1) // 63 AS fold, least(8, (n - first - 1) // 63) AS folds FROM (
        SELECT *, CASE WHEN n < 800 THEN 252 ELSE 504 END AS first FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol, period, config ORDER BY date) - 1 AS pos,
            count(*) OVER (PARTITION BY symbol, period, config) AS n FROM grid_ds))
      WHERE n >= first + 63 + 1 AND pos >= first + 1) WHERE fold < folds""",
)
sql_table(
    "grid_pred",
    """SELECT symbol, period, config, 'AlwaysLong' AS model, hold, date, y, 1 AS prediction FROM grid_test UNION ALL
       SELECT symbol, period, config, 'PreviousDirection', hold, date, y, CAST(return_1d > 0 AS INTEGER) FROM grid_test""",
)
_G = "symbol, period, config, model"
sql_table("grid_bt", backtest_sql("grid_pred", _G, 5.0, "hold", (1, 5)))
sql_table(
    "grid_rows",
    f"""SELECT * FROM (SELECT {_G}, avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END) AS accuracy,
          100 * avg(prediction) AS long_pct FROM grid_pred GROUP BY ALL)
        JOIN ({summary_sql('grid_bt', 'strategy_return', _G, 'position')}) USING ({_G})""",
)
sql_table(
    "grid_best",
    """SELECT * EXCLUDE (rn) FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY round(sharpe, 10) DESC, config, model) AS rn
         FROM grid_rows WHERE sharpe IS NOT NULL) JOIN (
         SELECT symbol, period, coalesce(max(sharpe) FILTER (WHERE model <> 'AlwaysLong')
             > coalesce(max(sharpe) FILTER (WHERE model = 'AlwaysLong'), '-inf'::DOUBLE), false) AS trained_beat
         FROM grid_rows GROUP BY ALL) USING (symbol, period) WHERE rn = 1""",
)
GRID = "symbol:t period:t config:t model:t accuracy:8 total_return:6 sharpe:6 max_drawdown:6 turnover:8 long_pct:8"


def _grid(spark, sf):
    return ex.run_grid(inputs.bars(spark, sf), PERIODS, RULES)


query("p1_experiment_grid_rules", GRID, _grid, "SELECT * FROM grid_rows")
query(
    "p1_experiment_grid_learned",
    GRID,
    lambda spark, sf: ex.run_grid(
        inputs.bars(spark, sf),
        PERIODS,
        {
            "AlwaysLong": mo.AlwaysLong(),
            "CalibratedLR": mo.CalibratedLogisticRegression(),
            "RandomForest": mo.RandomForest(),
        },
    ),
)
query(
    "p2_best_per_group",
    GRID + " trained_beat:b",
    lambda spark, sf: ex.best_per_group(_grid(spark, sf)),
    "SELECT * FROM grid_best",
)
query(
    "p3_trained_beats_baseline",
    "n_groups:l n_trained_beat:l",
    lambda spark, sf: ex.beat_count(_grid(spark, sf)),
    """SELECT (SELECT count(*) FROM (SELECT DISTINCT symbol, period FROM grid_rows)) AS n_groups,
         (SELECT count(*) FROM grid_best WHERE trained_beat) AS n_trained_beat""",
)


def _curves(spark, sf):
    data = kept(make_dataset(inputs.bars(spark, sf)), "dataset")
    both = None
    for name, model in RULES.items():
        rows = wf.walk_forward_scores(data, model, inputs.SPLITTER).withColumn("strategy", F.lit(name))
        both = rows if both is None else both.unionByName(rows)
    return strategy_curves(run_backtest(both, None, 5.0, keys=["symbol", "strategy"]))


sql_table(
    "two_rules",
    """SELECT symbol, 'AlwaysLong' AS strategy, date, 1 AS prediction FROM wf_direction UNION ALL
       SELECT symbol, 'PreviousDirection', date, prediction FROM wf_direction""",
)
sql_table("two_bt", backtest_sql("two_rules", "symbol, strategy", 5.0))
query(
    "p4_strategy_curves",
    "symbol:t curve:t date:d value:6 final_return:6",
    _curves,
    """SELECT *, arg_max(value, date) OVER (PARTITION BY symbol, curve) - 1 AS final_return FROM (
         SELECT symbol, 'buy_and_hold' AS curve, date, buy_and_hold AS value FROM two_bt WHERE strategy = 'AlwaysLong'
         UNION ALL SELECT symbol, strategy, date, cumulative FROM two_bt)""",
)
