"""Ranking, signals, logs, rebalancing, orders, replay and signal analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from barloom.operators import forward_returns as fr
from barloom.operators import models as mo
from barloom.operators import orders as od
from barloom.operators import quality, ranking, rebalance, replay, signals
from barloom.operators.splits import WalkForwardSplit
from barloom.plans import inputs
from barloom.session import kept, shared_dir
from barloom.sources import account_state, order_log, signal_log
import catalog.panel  # noqa: F401  (defines the feature and dataset tables)
from barloom.operators.features import FEATURE_COLUMNS
from catalog.base import SYM, complete, features_sql, full, query, sql_table, summary_sql

CONTEXT = "return_20d:8 return_60d:8 volatility_20d:8 price_vs_sma_200:8 above_sma_200:b"

# --- ranking ---------------------------------------------------------------

_J1 = WalkForwardSplit(5, 252, 63, 1)
query(
    "j1_rank_universe_rule",
    "symbol:t score:8",
    lambda spark, sf: ranking.rank_universe(
        inputs.bars(spark, sf), mo.PreviousDirection(), _J1, start="1995-06-01", end="2000-12-31"
    ),
    f"""SELECT symbol, arg_max(CAST(return_1d > 0 AS DOUBLE), date) AS score FROM (
          SELECT *, row_number() OVER ({SYM}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM (
            SELECT * FROM (SELECT *, lead(close) OVER ({SYM}) AS nxt, row_number() OVER ({SYM}) AS rn,
                close / lag(close) OVER ({SYM}) - 1 AS return_1d FROM bars
              WHERE date BETWEEN DATE '1995-06-01' AND DATE '2000-12-31') WHERE rn > 20 AND nxt IS NOT NULL))
        WHERE n >= 568 AND pos >= 253 AND pos < 568 GROUP BY symbol""",
)
query(
    "j1_rank_universe_calibrated",
    "symbol:t score:8",
    lambda spark, sf: ranking.rank_universe(
        inputs.bars(spark, sf), mo.CalibratedLogisticRegression(), WalkForwardSplit(5, 252, 63, 1, anchor="end")
    ),
)


def _skip_bars(spark, sf):
    """The bars, with symbols that no model can be fitted to: always rising, rarely falling, too short."""
    from pyspark.sql import Window

    panel = inputs.bars(spark, sf).select("symbol", "date", "close")
    one = panel.filter("symbol = '1-URGENT'").withColumn("t", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    rising = 100.0 + F.col("t") + 2.0 * (F.col("t") % 2)
    rare = rising - F.when(F.col("t").between(100, 103), 50.0).otherwise(0.0)
    for name, rows, close in (("RISING", one, rising), ("RARE", one, rare), ("SHORT", one.filter("t <= 300"), F.col("close"))):
        panel = panel.unionByName(rows.select(F.lit(name).alias("symbol"), "date", close.alias("close")))
    return panel


sql_table("skip_one", f"SELECT date, close, row_number() OVER ({SYM}) AS t FROM bars WHERE symbol = '1-URGENT'")
sql_table(
    "skip_bars",
    """SELECT symbol, date, close FROM bars UNION ALL SELECT 'RISING', date, 100.0 + t + 2 * (t % 2) FROM skip_one
       UNION ALL SELECT 'RARE', date, 100.0 + t + 2 * (t % 2) - CASE WHEN t BETWEEN 100 AND 103 THEN 50 ELSE 0 END FROM skip_one
       UNION ALL SELECT 'SHORT', date, close FROM skip_one WHERE t <= 300""",
)
sql_table("skip_feats", features_sql("skip_bars"))
sql_table(
    "skip_rows",
    f"""SELECT *, row_number() OVER ({SYM}) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM (
          SELECT *, CASE WHEN lead(close, 5) OVER ({SYM}) IS NOT NULL THEN CAST(lead(close, 5) OVER ({SYM}) > close AS INTEGER) END AS y
          FROM skip_feats) WHERE {complete(FEATURE_COLUMNS)} AND y IS NOT NULL""",
)
query(
    "j1_skipped_symbols",
    "symbol:t n:l reason:t",
    lambda spark, sf: ranking.skipped_symbols(_skip_bars(spark, sf), WalkForwardSplit(5, 252, 63, 1), "direction_5d", mo.CalibratedLogisticRegression()),
    """SELECT symbol, n, 'too few rows' AS reason FROM (SELECT DISTINCT symbol, n FROM skip_rows) WHERE n < 252 + 5 * 63 + 1
       UNION ALL SELECT symbol, rare, CASE WHEN rare = 0 THEN 'one class' ELSE 'too few rows of a class' END FROM (
         SELECT symbol, least(sum(y), count(*) - sum(y)) AS rare FROM skip_rows WHERE pos < 252 AND n >= 252 + 5 * 63 + 1 GROUP BY symbol) WHERE rare < 5""",
)
@dataclass(frozen=True)
class BaseRate:
    """A model of a user's own: P(up) is the share of ups among the training rows."""

    min_per_class: int = 5

    def fit_score(self, x, y, test):
        return [y.mean()] * len(test)


query(
    "j1_ranked_beside_skipped",
    "symbol:t score:8",
    lambda spark, sf: ranking.rank_universe(_skip_bars(spark, sf), BaseRate(), WalkForwardSplit(5, 252, 63, 1), "direction_5d"),
    # the last score comes from the last fold's training rows
    """SELECT symbol, avg(y) AS score FROM skip_rows WHERE n >= 252 + 5 * 63 + 1 AND pos < 252 + 4 * 63
         AND symbol IN (SELECT symbol FROM skip_rows WHERE pos < 252 GROUP BY symbol HAVING least(sum(y), count(*) - sum(y)) >= 5) GROUP BY symbol""",
)

sql_table(
    "context",
    f"""SELECT symbol, date, close / lag(close, 20) OVER ({SYM}) - 1 AS return_20d,
          close / lag(close, 60) OVER ({SYM}) - 1 AS return_60d, ({full('stddev_samp', 'r', 20)}) * sqrt(252) AS volatility_20d,
          close / ({full('avg', 'close', 200)}) - 1 AS price_vs_sma_200, close > ({full('avg', 'close', 200)}) AS above_sma_200
        FROM (SELECT *, close / lag(close) OVER ({SYM}) - 1 AS r FROM bars)""",
)
sql_table(
    "rule_score",
    f"""SELECT symbol, date, score FROM (SELECT *, {full('avg', 'up', 20)} AS score
          FROM (SELECT *, CAST(close > lag(close) OVER ({SYM}) AS DOUBLE) AS up FROM bars)) WHERE score IS NOT NULL""",
)
sql_table(
    "months",
    """SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS next_as_of
       FROM (SELECT max(date) AS as_of FROM bars GROUP BY date_trunc('month', date))""",
)
sql_table(
    "ranking_m",
    """SELECT as_of, s.symbol, score, c.* EXCLUDE (symbol, date) FROM rule_score s JOIN months ON s.date = as_of
       LEFT JOIN context c ON c.symbol = s.symbol AND c.date = s.date""",
)
sql_table(
    "held_m",
    f"""SELECT next_as_of AS as_of, symbol FROM (
          SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rk
          FROM rule_score JOIN months ON date = as_of) WHERE rk <= {inputs.TOP_N} AND next_as_of IS NOT NULL""",
)
query(
    "j2_enriched_ranking",
    f"as_of:d symbol:t score:8 {CONTEXT}",
    lambda spark, sf: inputs.Desk(spark, sf).ranking,
    "SELECT * FROM ranking_m",
)
query(
    "j2_enriched_latest_unknown_symbol",
    f"symbol:t score:8 {CONTEXT}",
    lambda spark, sf: ranking.enrich_with_context(
        ranking.latest_scores(inputs.scores(inputs.bars(spark, sf))).withColumn(
            "symbol", F.when(F.col("symbol") == "5-LOW", "unknown").otherwise(F.col("symbol"))
        ),
        inputs.bars(spark, sf),
    ),
    """SELECT CASE WHEN s.symbol = '5-LOW' THEN 'unknown' ELSE s.symbol END AS symbol, score,
         c.* EXCLUDE (symbol, date) FROM (SELECT symbol, arg_max(score, date) AS score FROM rule_score GROUP BY symbol) s
       LEFT JOIN (SELECT * FROM context WHERE symbol <> '5-LOW'
         AND (symbol, date) IN (SELECT symbol, max(date) FROM bars GROUP BY symbol)) c ON c.symbol = s.symbol""",
)
query(
    "j3_context_history",
    f"symbol:t date:d {CONTEXT}",
    lambda spark, sf: ranking.context_history(inputs.bars(spark, sf)),
    "SELECT * FROM context",
)
query(
    "j3_context_latest",
    f"symbol:t {CONTEXT}",
    lambda spark, sf: ranking.latest_context(inputs.bars(spark, sf)),
    "SELECT * FROM context WHERE (symbol, date) IN (SELECT symbol, max(date) FROM bars GROUP BY symbol)",
)

# --- signals ---------------------------------------------------------------

_MIN, _DOWN, _TOP = inputs.MIN_SCORE, inputs.MIN_SCORE_DOWN, inputs.TOP_N
sql_table(
    "signals_m",
    f"""SELECT as_of, symbol, score, action,
          CASE WHEN blocked THEN printf('blocked: below SMA200 and score %.3f < min_score_downtrend {_DOWN}', score) ELSE '' END AS reason
        FROM (SELECT *, CASE WHEN target AND held THEN 'hold' WHEN target THEN 'buy' WHEN held THEN 'sell'
                WHEN blocked THEN 'blocked' END AS action
          FROM (SELECT coalesce(g.as_of, h.as_of) AS as_of, coalesce(g.symbol, h.symbol) AS symbol, score,
                  coalesce(blocked, false) AS blocked, h.symbol IS NOT NULL AS held,
                  coalesce(eligible AND rk <= {_TOP}, false) AS target
            FROM (SELECT *, row_number() OVER (PARTITION BY as_of, eligible ORDER BY score DESC, symbol) AS rk
                  FROM (SELECT as_of, symbol, score, score >= {_MIN} AND above_sma_200 IS FALSE AND score < {_DOWN} AS blocked,
                          score >= {_MIN} AND NOT (above_sma_200 IS FALSE AND score < {_DOWN}) AS eligible FROM ranking_m)) g
            FULL JOIN held_m h ON g.as_of = h.as_of AND g.symbol = h.symbol))
        WHERE action IS NOT NULL""",
)
_ORDERED = """row_number() OVER (PARTITION BY {keys} ORDER BY CASE action WHEN 'buy' THEN 1 WHEN 'hold' THEN 2
    WHEN 'sell' THEN 3 ELSE 4 END, score DESC NULLS LAST, symbol)"""
query(
    "j4_signals",
    "as_of:d symbol:t action:t score:8 reason:t",
    lambda spark, sf: inputs.Desk(spark, sf).signals,
    "SELECT * FROM signals_m",
)
query(
    "j5_signal_order",
    "as_of:d seq:l symbol:t action:t score:8",
    lambda spark, sf: signals.order_signals(signals.signal_sequence(inputs.Desk(spark, sf).signals)),
    f"SELECT *, {_ORDERED.format(keys='as_of')} AS seq FROM signals_m",
)


def _candidates(desk):
    return signals.candidate_table(desk.ranking, desk.held, top_n=_TOP, min_score=_MIN, shown=4)


query(
    "j6_candidate_table",
    "as_of:d rank:i symbol:t score:8 status:t held_mark:t return_20d:8",
    lambda spark, sf: _candidates(inputs.Desk(spark, sf)),
    f"""SELECT *, CASE WHEN rank > {_TOP} THEN '' WHEN score >= {_MIN} THEN 'eligible' ELSE '(below min_score)' END AS status
        FROM (SELECT r.as_of, r.symbol, score, return_20d, CASE WHEN h.symbol IS NULL THEN '' ELSE '*' END AS held_mark,
                row_number() OVER (PARTITION BY r.as_of ORDER BY score DESC, r.symbol) AS rank
              FROM ranking_m r LEFT JOIN held_m h ON h.as_of = r.as_of AND h.symbol = r.symbol) WHERE rank <= 4""",
)

# --- signal log ------------------------------------------------------------

LOG = f"date:d rank:i symbol:t score:8 action:t reason:t {CONTEXT}"
sql_table(
    "log_m",
    """SELECT r.as_of AS date, r.symbol, r.score, r.* EXCLUDE (as_of, symbol, score),
         row_number() OVER (PARTITION BY r.as_of ORDER BY r.score DESC, r.symbol) AS rank,
         coalesce(s.action, '') AS action, coalesce(s.reason, '') AS reason
       FROM ranking_m r LEFT JOIN signals_m s ON s.as_of = r.as_of AND s.symbol = r.symbol""",
)


def _desk_log(desk):
    return signal_log.signal_log_rows(desk.ranking, desk.signals)


def _log_rows(spark, sf):
    return _desk_log(inputs.Desk(spark, sf))


def _log_path(spark, sf):
    path = shared_dir(spark, "signals")
    signal_log.write_signal_log(_log_rows(spark, sf), path)
    return path


_READ = "SELECT * REPLACE (CASE WHEN action = '' THEN '(no action)' ELSE action END AS action), strftime(date, '%Y-%m-%d') AS file FROM log_m"


def _mixed_log(spark, sf):
    """The log with full UTC stamps for later years and one bad score per file, written as text."""
    path = shared_dir(spark, "mixed-signals")
    rows = _log_rows(spark, sf)
    text = F.date_format("date", "yyyy-MM-dd")
    stamp = F.when(F.year("date") >= 1998, F.concat(text, F.lit(" 00:00:00+00:00"))).otherwise(text)
    bad = F.when(F.col("rank") == 3, F.lit("n/a")).otherwise(F.col("score").cast("string"))
    flag = F.when(F.col("above_sma_200"), "True").when(~F.col("above_sma_200"), "False")
    (
        rows.withColumns({"file_date": text, "score": bad, "above_sma_200": flag})
        .withColumn("date", stamp)
        .repartition("file_date")
        .write.option("header", True)
        .partitionBy("file_date")
        .csv(path)
    )
    return path


query(
    "a5_signal_log_scan",
    LOG + " file:t",
    lambda spark, sf: signal_log.read_signal_log(spark, _mixed_log(spark, sf)),
    f"SELECT * REPLACE (CASE WHEN rank <> 3 THEN score END AS score) FROM ({_READ})",
)
query(
    "a6_latest_signal_file",
    LOG + " file:t",
    lambda spark, sf: signal_log.read_latest_signals(spark, _log_path(spark, sf)),
    f"SELECT * FROM ({_READ}) WHERE date = (SELECT max(as_of) FROM months)",
)
query("a7_signal_log_rows", LOG, _log_rows, "SELECT * FROM log_m")
query(
    "b2_signal_file_check",
    "file:t n_dates:l is_valid:b",
    lambda spark, sf: quality.signal_file_check(
        _log_rows(spark, sf).withColumn(
            "file", F.date_format("date", "yyyy-MM-dd").substr(F.lit(1), F.when(F.year("date") < 1998, 10).otherwise(4))
        )
    ),
    """SELECT file, count(DISTINCT date) AS n_dates, count(DISTINCT date) <= 1 AS is_valid FROM (
         SELECT date, left(strftime(date, '%Y-%m-%d'), CASE WHEN year(date) < 1998 THEN 10 ELSE 4 END) AS file FROM log_m)
       GROUP BY file""",
)
query(
    "b3_executable_actions",
    "date:d symbol:t action:t score:8 reason:t",
    lambda spark, sf: quality.executable_actions(
        _log_rows(spark, sf).withColumns(
            {
                "action": F.concat(F.lit(" "), F.upper("action")),
                "score": F.when(F.col("rank") < 4, F.col("score")),
            }
        )
    ),
    """SELECT * REPLACE (CASE WHEN rank < 4 THEN score ELSE 0 END AS score) FROM log_m
       WHERE action IN ('buy', 'sell', 'hold')""",
)
query(
    "n6_load_statistics",
    "n_rows:l n_files:l n_symbols:l n_dates:l",
    lambda spark, sf: fr.load_statistics(signal_log.read_signal_log(spark, _log_path(spark, sf))),
    """SELECT count(*) AS n_rows, count(DISTINCT date) AS n_files, count(DISTINCT symbol) AS n_symbols,
         count(DISTINCT date) AS n_dates FROM log_m""",
)

# --- forward returns -------------------------------------------------------


def _requests(desk):
    return _desk_log(desk).withColumn("date", F.last_day("date"))


sql_table("asked", "SELECT * REPLACE (last_day(date) AS date) FROM log_m")
sql_table(
    "ahead",
    "SELECT symbol, date AS entry_date, "
    + ", ".join(f"lead(close, {h}) OVER ({SYM}) / close - 1 AS {fr.forward_name(h)}" for h in fr.HORIZONS)
    + " FROM bars",
)
sql_table(
    "asked_fwd",
    "SELECT a.*, h.* EXCLUDE (symbol) FROM asked a ASOF LEFT JOIN ahead h ON a.symbol = h.symbol AND a.date <= h.entry_date",
)
FORWARD = " ".join(f"{fr.forward_name(h)}:8" for h in fr.HORIZONS)


def _entries(desk):
    return fr.entry_bars(_requests(desk), desk.bars)


query(
    "n1_entry_bars",
    "symbol:t date:d entry_date:d",
    lambda spark, sf: _entries(inputs.Desk(spark, sf)),
    "SELECT DISTINCT symbol, date, entry_date FROM asked_fwd",
)


def _forward(spark, sf):
    desk = inputs.Desk(spark, sf)
    return fr.add_forward_returns(_requests(desk), desk.bars)


query("n2_forward_returns", f"{LOG} {FORWARD}", _forward, "SELECT * FROM asked_fwd")


def _summary_sql() -> str:
    parts = ["count(*) AS n"]
    for h in fr.HORIZONS:
        r = fr.forward_name(h)
        parts.append(
            f"count({r}) AS n_valid_{h}d, avg({r}) AS avg_{h}d, "
            f"avg(CASE WHEN {r} > 0 THEN 1.0 WHEN {r} <= 0 THEN 0.0 END) AS win_{h}d"
        )
    return ", ".join(parts)


STATS = "n:l " + " ".join(f"n_valid_{h}d:l avg_{h}d:8 win_{h}d:8" for h in fr.HORIZONS)
sql_table(
    "graded",
    """SELECT * REPLACE (CASE WHEN action = '' THEN '(no action)' ELSE action END AS action),
         CASE WHEN above_sma_200 THEN 'above_SMA' WHEN NOT above_sma_200 THEN 'below_SMA' ELSE 'SMA_unknown' END AS sma,
         CASE WHEN score < 0 THEN NULL WHEN score < 0.55 THEN '<0.55' WHEN score < 0.60 THEN '0.55-0.60'
           WHEN score < 0.65 THEN '0.60-0.65' WHEN score < 1.01 THEN '>0.65' END AS bucket FROM asked_fwd""",
)
query(
    "n3_group_summary",
    f"symbol:t {STATS}",
    lambda spark, sf: fr.summarise_group(_forward(spark, sf), ["symbol"]),
    f"SELECT symbol, {_summary_sql()} FROM asked_fwd GROUP BY symbol",
)
query(
    "n4_score_bucket",
    "symbol:t date:d score:8 bucket:t",
    lambda spark, sf: _log_rows(spark, sf).withColumn("bucket", fr.score_bucket(F.col("score"))),
    "SELECT symbol, log_m.date, log_m.score, bucket FROM log_m JOIN (SELECT DISTINCT score, bucket FROM graded) USING (score)",
)
query(
    "n5_signal_summaries",
    f"summary:t action:t sma:t bucket:t {STATS}",
    lambda spark, sf: fr.signal_summaries(_forward(spark, sf)),
    f"""SELECT 'action' AS summary, action, NULL AS sma, NULL AS bucket, {_summary_sql()} FROM graded GROUP BY action
        UNION ALL SELECT 'action_sma', action, sma, NULL, {_summary_sql()} FROM graded GROUP BY action, sma
        UNION ALL SELECT 'action_bucket', action, NULL, bucket, {_summary_sql()} FROM graded GROUP BY action, bucket""",
)
query(
    "n7_sma_label",
    "symbol:t date:d sma:t",
    lambda spark, sf: _log_rows(spark, sf).withColumn("sma", fr.sma_label(F.col("above_sma_200"))),
    "SELECT symbol, as_of AS date, sma FROM ranking_m JOIN (SELECT DISTINCT above_sma_200 AS a, sma FROM graded) ON above_sma_200 IS NOT DISTINCT FROM a",
)


def _analysis(spark, sf):
    path = shared_dir(spark, "analysis")
    rows = _forward(spark, sf)
    signal_log.write_analysis(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


query(
    "a8_analysis_sink",
    f"date:d symbol:t rank:i score:8 {FORWARD}",
    _analysis,
    "SELECT * FROM asked_fwd",
)

# --- rebalancing -----------------------------------------------------------

_SIM = dict(top_n=2, min_score=0.5)
sql_table("sim_days", "SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM bars)")
sql_table(
    "matrix",
    """SELECT * FROM (SELECT date, symbol, filled, lag(filled) OVER (PARTITION BY symbol ORDER BY date) AS score FROM (
         SELECT d.date, y.symbol, last_value(s.score IGNORE NULLS) OVER (PARTITION BY y.symbol ORDER BY d.date
             ROWS UNBOUNDED PRECEDING) AS filled
         FROM sim_days d CROSS JOIN (SELECT DISTINCT symbol FROM bars) y
         LEFT JOIN rule_score s ON s.date = d.date AND s.symbol = y.symbol)) WHERE filled IS NOT NULL""",
)
sql_table(
    "reb_days",
    """SELECT date, row_number() OVER (ORDER BY date) AS rebalance FROM (
         SELECT min(date) AS date FROM sim_days GROUP BY isoyear(date), weekofyear(date))""",
)
sql_table(
    "steps",
    """SELECT date, row_number() OVER (ORDER BY date) AS step FROM (
         SELECT DISTINCT date FROM reb_days JOIN matrix USING (date) WHERE score IS NOT NULL)""",
)
sql_table(
    "target_sets",
    """SELECT step, symbol, score FROM (
         SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, symbol) AS rk
         FROM steps JOIN matrix USING (date) WHERE score >= 0.5) WHERE rk <= 2""",
)
sql_table(
    "set_sizes",
    """SELECT s.step, s.date, count(t.symbol) AS n_new,
         (SELECT count(*) FROM target_sets o WHERE o.step = s.step - 1) AS n_old,
         count(o.symbol) AS n_common
       FROM steps s LEFT JOIN target_sets t ON t.step = s.step
       LEFT JOIN target_sets o ON o.step = s.step - 1 AND o.symbol = t.symbol GROUP BY s.step, s.date""",
)
sql_table(
    "set_costs",
    """SELECT *, CASE WHEN n_old = 0 AND n_new = 0 THEN 0.0 WHEN n_old = 0 OR n_new = 0 THEN 1.0
         ELSE (n_common * abs(1.0::DOUBLE / n_new - 1.0::DOUBLE / n_old) + (n_old - n_common)::DOUBLE / n_old
           + (n_new - n_common)::DOUBLE / n_new) / 2 END AS one_way FROM set_sizes""",
)
sql_table(
    "sim_daily",
    """SELECT d.date, c.step = s.step AND c.date = d.date AS acts, c.one_way, c.n_new,
         coalesce((SELECT sum(r.ret) FROM target_sets t JOIN (
             SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars) r
             ON r.symbol = t.symbol WHERE t.step = s.step AND r.date = d.date), 0) / nullif(c.n_new, 0) AS ret
       FROM sim_days d ASOF LEFT JOIN steps s ON d.date >= s.date LEFT JOIN set_costs c ON c.step = s.step""",
)
sql_table(
    "sim_curve",
    """SELECT 'base' AS scenario, date, 1000 * product(factor) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS value,
         coalesce(ret, 0) AS portfolio_return
       FROM (SELECT *, CASE WHEN acts THEN greatest(0, 1 - one_way * 5 * 1e-4) ELSE 1 END * (1 + coalesce(ret, 0)) AS factor
             FROM sim_daily)""",
)
sql_table(
    "sim_trades",
    """SELECT 'base' AS scenario, s.date, x.symbol, x.action, m.score FROM (
         SELECT t.step, t.symbol, 'buy' AS action FROM target_sets t
         ANTI JOIN target_sets o ON o.step = t.step - 1 AND o.symbol = t.symbol
         UNION ALL SELECT o.step + 1, o.symbol, 'sell' FROM target_sets o
         ANTI JOIN target_sets t ON t.step = o.step + 1 AND t.symbol = o.symbol) x
       JOIN steps s ON s.step = x.step LEFT JOIN matrix m ON m.date = s.date AND m.symbol = x.symbol""",
)


def _with_sim(fn):
    def run(spark, sf):
        bars = inputs.Desk(spark, sf).bars
        return fn(inputs.scores(bars), bars)

    return run


query(
    "k1_probability_matrix",
    "scenario:t date:d symbol:t filled:8",
    _with_sim(rebalance.daily_score_matrix),
    "SELECT 'base' AS scenario, date, symbol, filled FROM matrix",
)
query(
    "k2_lagged_scores",
    "scenario:t date:d symbol:t score:8",
    _with_sim(lambda s, b: rebalance.daily_score_matrix(s, b).filter("score is not null")),
    "SELECT 'base' AS scenario, date, symbol, score FROM matrix WHERE score IS NOT NULL",
)
query(
    "k3_rebalance_days",
    "scenario:t date:d rebalance:i",
    _with_sim(rebalance.weekly_rebalance_dates),
    "SELECT 'base' AS scenario, * FROM reb_days",
)
query(
    "k4_rebalance_ranking",
    "scenario:t date:d symbol:t score:8 rank:i",
    _with_sim(lambda s, b: rebalance.rebalance_ranking(s, b, 3)),
    """SELECT 'base' AS scenario, * FROM (SELECT date, symbol, score,
         row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank
         FROM reb_days JOIN matrix USING (date) WHERE score IS NOT NULL) WHERE rank <= 3""",
)
query(
    "k5_transaction_costs",
    "scenario:t date:d n_old:l n_new:l n_common:l one_way:8 cost_fraction:8",
    _with_sim(lambda s, b: rebalance.rebalance_costs(s, b, **_SIM)),
    """SELECT 'base' AS scenario, *, one_way * 5 * 1e-4 AS cost_fraction FROM set_costs WHERE n_old > 0 OR n_new > 0""",
)
query(
    "k6_equal_weight_returns",
    "scenario:t date:d portfolio_return:8",
    _with_sim(lambda s, b: rebalance.held_returns(s, b, **_SIM)),
    "SELECT * FROM sim_curve",
)


def _simulated(spark, sf):
    bars = inputs.Desk(spark, sf).bars
    return rebalance.simulate(inputs.scores(bars), bars, costs_bps=5.0, initial_capital=1000.0, **_SIM)


query(
    "k7_equity_curve",
    "scenario:t date:d value:4",
    lambda spark, sf: _simulated(spark, sf).equity_curve,
    "SELECT * FROM sim_curve",
)
query(
    "k8_trades_log",
    "scenario:t date:d symbol:t action:t score:8",
    lambda spark, sf: _simulated(spark, sf).trades_log,
    "SELECT * FROM sim_trades",
)

# --- orders ----------------------------------------------------------------

sql_table(
    "accounts_t",
    """SELECT n_name AS account, balance, balance * (0.7::DOUBLE + 0.1::DOUBLE * n_regionkey) AS cash FROM (
         SELECT n_name, n_regionkey, 5000.0::DOUBLE + 10 * count(*) AS balance
         FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)""",
)
sql_table(
    "subscribed",
    """SELECT DISTINCT n_name AS account, o_orderpriority AS symbol FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey""",
)
sql_table(
    "account_signals_t",
    f"""SELECT account, as_of AS signal_date, symbol, action, score, reason,
          {_ORDERED.format(keys='account, as_of')} AS seq FROM signals_m JOIN subscribed USING (symbol)""",
)
sql_table(
    "proposed_t",
    """SELECT account, signal_date, seq, symbol, CASE action WHEN 'buy' THEN 'BUY' ELSE 'SELL' END AS side,
         CASE action WHEN 'buy' THEN round(0.20::DOUBLE * balance, 2) ELSE 0 END AS amount, score, reason AS signal_reason, balance, cash
       FROM account_signals_t JOIN accounts_t USING (account) WHERE action IN ('buy', 'sell')""",
)
ORDER = "account:t signal_date:d seq:l symbol:t side:t amount:2 score:8 signal_reason:t"
query("l1_proposed_orders", ORDER, lambda spark, sf: inputs.Desk(spark, sf).proposed, "SELECT * FROM proposed_t")

_RULES = """CASE
    WHEN side = 'SELL' AND NOT is_open THEN 'short_sell'
    WHEN side = 'BUY' AND n_open >= 3 THEN 'max_positions'
    WHEN balance > 0 AND amount > 0.20::DOUBLE * balance THEN 'max_trade_size'
    WHEN side = 'BUY' AND cash - amount < 0.65::DOUBLE * balance THEN 'cash_buffer'
    WHEN symbol = '2-HIGH' THEN 'universe' ELSE '' END"""
_REASONS = """CASE rule WHEN 'leverage' THEN printf('Leverage %dx is not allowed.  Only leverage=1 (no leverage) is permitted.', leverage)
    WHEN 'short_sell' THEN printf('Cannot SELL %s: symbol is not in current positions.  Short selling is not permitted.', symbol)
    WHEN 'max_positions' THEN printf('Cannot open new position in %s: already holding %d / 3 maximum positions.', symbol, n_open)
    WHEN 'max_trade_size' THEN printf('Order amount %.2f exceeds 20%% of account balance (%.2f).', amount, 0.20::DOUBLE * balance)
    WHEN 'cash_buffer' THEN printf('Insufficient cash: buying %.2f would leave %.2f which is below the required 65%% buffer (%.2f).',
      amount, cash - amount, 0.65::DOUBLE * balance)
    WHEN 'universe' THEN printf('%s is not in the approved trading universe.', symbol) ELSE '' END"""


def _single_orders(spark, sf):
    """Customer orders read as trades of the nation's account, each checked on its own."""
    o = inputs.table(spark, sf, "orders")
    c = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    trades = o.join(c, "o_custkey").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("leverage"),
        F.lit(1_000_000.0).alias("balance"),
        (F.lit(700_000.0) + F.col("c_acctbal") * 10).alias("cash"),
        (F.col("c_nationkey") / 8).cast("int").cast("long").alias("n_open"),
        (F.col("c_acctbal") > 0).alias("is_open"),
    )
    return od.validate_orders(trades, inputs.RISK)


query(
    "l2_risk_rules",
    "o_orderkey:l symbol:t side:t risk_approved:b risk_rule:t risk_reason:t",
    _single_orders,
    f"""SELECT *, {_REASONS} AS risk_reason, rule AS risk_rule, rule = '' AS risk_approved FROM (
          SELECT *, CASE WHEN leverage <> 1 THEN 'leverage' ELSE {_RULES} END AS rule FROM (
            SELECT o_orderkey, o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side,
              o_totalprice AS amount, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS leverage,
              1000000.0::DOUBLE AS balance, 700000.0::DOUBLE + c_acctbal * 10 AS cash, c_nationkey // 8 AS n_open,
              c_acctbal > 0 AS is_open
            FROM orders JOIN customer ON c_custkey = o_custkey))""",
)

sql_table("plan_rows", "SELECT * EXCLUDE (cash), row_number() OVER (PARTITION BY account, signal_date ORDER BY seq) AS turn FROM proposed_t")
sql_table(
    "plan_open",
    """SELECT p.account, p.signal_date, balance, cash, coalesce(list(h.symbol) FILTER (WHERE h.symbol IS NOT NULL), []::VARCHAR[]) AS held
       FROM (SELECT DISTINCT account, signal_date, balance, cash FROM proposed_t) p
       LEFT JOIN (SELECT as_of, symbol, account FROM held_m JOIN subscribed USING (symbol)) h
         ON h.as_of = p.signal_date AND h.account = p.account GROUP BY ALL""",
)
sql_table(
    "plan_steps",
    f"""SELECT account, signal_date, 0::BIGINT AS turn, cash AS cash_after, held, NULL::BIGINT AS seq, NULL::VARCHAR AS symbol,
          NULL::VARCHAR AS side, NULL::DOUBLE AS amount, NULL::DOUBLE AS score, NULL::VARCHAR AS signal_reason, balance,
          NULL::DOUBLE AS cash, NULL::BIGINT AS n_open, NULL::VARCHAR AS rule FROM plan_open
        UNION ALL
        SELECT account, signal_date, turn, CASE WHEN rule = '' AND side = 'BUY' THEN cash - amount ELSE cash END,
          CASE WHEN rule <> '' THEN held WHEN side = 'BUY' THEN list_distinct(list_append(held, symbol))
            ELSE list_filter(held, lambda x: x <> symbol) END,
          seq, symbol, side, amount, score, signal_reason, balance, cash, n_open, rule
        FROM (SELECT *, {_RULES} AS rule FROM (
          SELECT p.*, s.held, s.cash_after AS cash, len(s.held)::BIGINT AS n_open, list_contains(s.held, p.symbol) AS is_open
          FROM plan_steps s JOIN plan_rows p ON p.account = s.account AND p.signal_date = s.signal_date AND p.turn = s.turn + 1))""",
)
sql_table(
    "plan_t",
    f"""SELECT *, cash AS cash_before, n_open AS open_before, {_REASONS.replace("WHEN 'leverage' THEN printf('Leverage %dx is not allowed.  Only leverage=1 (no leverage) is permitted.', leverage)", "")} AS risk_reason,
          rule AS risk_rule, rule = '' AS risk_approved FROM plan_steps WHERE turn > 0""",
)
query(
    "l3_execution_plan",
    ORDER + " cash_before:4 open_before:l cash_after:4 risk_approved:b risk_rule:t risk_reason:t",
    lambda spark, sf: inputs.Desk(spark, sf).plan,
    "SELECT * FROM plan_t",
)
query(
    "l3_plan_summary",
    "account:t signal_date:d cash_before:4 cash_after_est:4 n_approved:l n_rejected:l",
    lambda spark, sf: od.plan_summary(inputs.Desk(spark, sf).plan, inputs.PLAN_KEYS),
    """SELECT account, signal_date, arg_min(cash_before, turn) AS cash_before, arg_max(cash_after, turn) AS cash_after_est,
         count(*) FILTER (WHERE risk_approved) AS n_approved, count(*) FILTER (WHERE NOT risk_approved) AS n_rejected
       FROM plan_t GROUP BY account, signal_date""",
)


def _numbered(spark, sf):
    """Approved orders of all plans with one running number per account."""
    plan = inputs.Desk(spark, sf).plan.filter("risk_approved")
    day = F.unix_date("signal_date").cast("long")
    return plan.withColumn("seq", day * 100_000 + F.col("seq"))


def _start_state(spark, sf):
    return account_state.with_defaults(inputs.Desk(spark, sf).accounts, None).withColumn(
        "positions", F.map_from_arrays(F.array(F.lit("1-URGENT"), F.lit("9-OTHER")), F.array(F.lit(1.0), F.lit(1.0)))
    )


def _flat_state(state):
    return state.withColumn("positions", F.concat_ws(",", F.sort_array(F.map_keys("positions"))))


STATE = "account:t cash:4 positions:t last_signal_date:d last_rebalance_date:d"
sql_table(
    "state_t",
    """SELECT a.account, greatest(0, 10000 - coalesce(spent, 0)) AS cash, last AS last_signal_date, last AS last_rebalance_date,
         (SELECT coalesce(string_agg(symbol, ',' ORDER BY symbol), '') FROM (
            SELECT symbol FROM (SELECT account, symbol, arg_max(side, (signal_date, seq)) AS side FROM plan_t WHERE risk_approved GROUP BY ALL) l
              WHERE l.account = a.account AND side = 'BUY'
            UNION SELECT s FROM (SELECT unnest(['1-URGENT', '9-OTHER']) AS s)
              WHERE s NOT IN (SELECT symbol FROM plan_t p WHERE p.account = a.account AND risk_approved))) AS positions
       FROM accounts_t a LEFT JOIN (SELECT account, sum(amount) FILTER (WHERE side = 'BUY') AS spent, max(signal_date) AS last
         FROM plan_t WHERE risk_approved GROUP BY account) USING (account)""",
)
query(
    "l4_apply_orders",
    STATE,
    lambda spark, sf: _flat_state(od.apply_orders(_start_state(spark, sf), _numbered(spark, sf))),
    "SELECT * FROM state_t",
)
query(
    "l5_account_snapshot",
    "account:t balance:4 cash:4 open_positions:t",
    lambda spark, sf: od.account_snapshot(
        od.apply_orders(_start_state(spark, sf), _numbered(spark, sf))
    ).withColumn("open_positions", F.concat_ws(",", "open_positions")),
    "SELECT account, cash AS balance, cash, positions AS open_positions FROM state_t",
)


def _state_table(spark, sf):
    """State saved for the accounts of half the regions and read back for all."""
    path = shared_dir(spark, "state")
    known = inputs.table(spark, sf, "nation").filter("n_regionkey >= 2").select(F.col("n_name").alias("account"))
    account_state.save_state(_start_state(spark, sf).join(known, "account", "left_semi"), path)
    return _flat_state(account_state.load_state(spark, path, inputs.Desk(spark, sf).accounts))


query(
    "a11_account_state",
    STATE,
    _state_table,
    """SELECT account, 10000 AS cash, CASE WHEN n_regionkey >= 2 THEN '1-URGENT,9-OTHER' ELSE '' END AS positions,
         NULL AS last_signal_date, NULL AS last_rebalance_date FROM accounts_t JOIN nation ON n_name = account""",
)

# --- order log -------------------------------------------------------------


def _logged(spark, sf):
    """The plan logged twice, the second time with each record repeated."""
    path = shared_dir(spark, "orders")
    records = _records(spark, sf)
    order_log.log_orders(records, path)
    order_log.log_orders(records.unionByName(records), path)
    return path


def _records(spark, sf):
    evening = F.concat(F.date_format("signal_date", "yyyy-MM-dd"), F.lit("T21:00:00+00:00"))
    return order_log.order_records(inputs.Desk(spark, sf).plan, generated_at=evening)


def _logged_plain(spark, sf):
    """The plan of all accounts as one book, in records without account and number, logged twice."""
    path = shared_dir(spark, "plain-orders")
    records = kept(_records(spark, sf).drop("account", "seq"), "records")
    order_log.log_orders(records, path)
    order_log.log_orders(records, path)
    return path


query(
    "a10_order_log_sink",
    "order_id:t timestamp:t signal_date:t dry_run:b type:t symbol:t side:t amount:2 score:8 signal_reason:t "
    "risk_approved:b risk_rule:t risk_reason:t broker_status:t broker_order_id:t account:t seq:l",
    lambda spark, sf: order_log.read_order_records(spark, _logged(spark, sf)),
    """SELECT *, concat_ws(':', day, symbol, side) AS order_id, day || 'T21:00:00+00:00' AS timestamp, true AS dry_run,
         CASE WHEN risk_approved THEN 'approved' ELSE 'rejected' END AS type, NULL AS broker_status, NULL AS broker_order_id
       FROM (SELECT * REPLACE (strftime(signal_date, '%Y-%m-%d') AS signal_date), strftime(signal_date, '%Y-%m-%d') AS day FROM plan_t)""",
)
sql_table(
    "plain_log",
    """SELECT * EXCLUDE (rn) FROM (SELECT * EXCLUDE (account, seq), row_number() OVER (PARTITION BY signal_date, symbol, side
         ORDER BY amount, score NULLS FIRST, risk_approved, signal_reason NULLS FIRST, risk_rule NULLS FIRST, risk_reason NULLS FIRST) AS rn
       FROM plan_t) WHERE rn = 1""",
)
query(
    "a10_order_log_plain",
    "order_id:t signal_date:t type:t symbol:t side:t amount:2 score:8 signal_reason:t risk_approved:b risk_rule:t risk_reason:t account:t seq:l",
    lambda spark, sf: order_log.read_order_records(spark, _logged_plain(spark, sf)),
    """SELECT * REPLACE (strftime(signal_date, '%Y-%m-%d') AS signal_date), concat_ws(':', strftime(signal_date, '%Y-%m-%d'), symbol, side) AS order_id,
         CASE WHEN risk_approved THEN 'approved' ELSE 'rejected' END AS type, 'default' AS account, NULL AS seq FROM plain_log""",
)
query(
    "a9_order_log_scan",
    "account:t date:d seq:l symbol:t side:t amount:2 score:8",
    lambda spark, sf: order_log.load_orders(spark, _logged(spark, sf)),
    "SELECT *, signal_date AS date FROM plan_t WHERE risk_approved",
)

# --- replay ----------------------------------------------------------------


def _history(spark, sf):
    return inputs.Desk(spark, sf).history


sql_table(
    "replay_rows",
    """SELECT p.account, p.signal_date AS date, p.seq, p.symbol, p.side, p.amount, b.close,
         row_number() OVER (PARTITION BY p.account ORDER BY p.signal_date, p.seq) AS turn
       FROM plan_t p JOIN bars b ON b.symbol = p.symbol AND b.date = p.signal_date WHERE p.risk_approved AND b.close > 0""",
)
sql_table(
    "replay_steps",
    """SELECT account, 0::BIGINT AS turn, NULL::DATE AS date, balance / 2 AS cash, MAP {}::MAP(VARCHAR, DOUBLE) AS owned,
         NULL::BIGINT AS seq, NULL::VARCHAR AS symbol, false AS executed FROM accounts_t
       UNION ALL
       SELECT r.account, r.turn, r.date,
         CASE WHEN side = 'SELL' THEN s.cash + coalesce(s.owned[r.symbol], 0) * close
              WHEN amount <= s.cash THEN s.cash - amount ELSE s.cash END,
         CASE WHEN side = 'SELL' THEN map_concat(s.owned, MAP {r.symbol: 0.0::DOUBLE})
              WHEN amount <= s.cash THEN map_concat(s.owned, MAP {r.symbol: coalesce(s.owned[r.symbol], 0) + amount / close})
              ELSE s.owned END,
         r.seq, r.symbol, CASE WHEN side = 'SELL' THEN coalesce(s.owned[r.symbol], 0) > 0 ELSE amount <= s.cash END
       FROM replay_steps s JOIN replay_rows r ON r.account = s.account AND r.turn = s.turn + 1""",
)
sql_table(
    "replay_daily",
    """SELECT d.account, d.date, coalesce(s.cash, d.capital) AS cash, s.owned
       FROM (SELECT account, balance / 2 AS capital, date FROM accounts_t CROSS JOIN sim_days) d
       ASOF LEFT JOIN (SELECT account, date, arg_max(cash, turn) AS cash, arg_max(owned, turn) AS owned
                       FROM replay_steps WHERE turn > 0 GROUP BY account, date) s ON s.account = d.account AND d.date >= s.date""",
)
sql_table(
    "replay_positions",
    """SELECT account, date, e.key AS symbol, e.value AS shares FROM (
         SELECT account, date, unnest(map_entries(owned)) AS e FROM replay_daily WHERE owned IS NOT NULL) WHERE e.value > 0""",
)
sql_table(
    "replay_equity",
    """SELECT d.account, d.date, d.cash, d.cash + coalesce(w.worth, 0) AS value FROM replay_daily d LEFT JOIN (
         SELECT account, date, sum(shares * close) AS worth FROM replay_positions JOIN bars USING (symbol, date)
         WHERE close > 0 GROUP BY account, date) w ON w.account = d.account AND w.date = d.date""",
)
query(
    "m1_executed_orders",
    "account:t date:d seq:l symbol:t executed:b cash_after:4",
    lambda spark, sf: replay.executed_orders(*inputs.Desk(spark, sf).replay_inputs),
    "SELECT *, cash AS cash_after FROM replay_steps WHERE turn > 0",
)


def _plain_replay(spark, sf):
    """Replay of the plain log: orders of a day stand in the order of the log."""
    orders = order_log.load_orders(spark, _logged_plain(spark, sf))
    capital = spark.range(1).select(F.lit("default").alias("account"), F.lit(100_000.0).alias("capital"))
    return replay.executed_orders(orders, inputs.bars(spark, sf), capital)


sql_table(
    "plain_rows",
    """SELECT p.signal_date AS date, p.symbol, p.side, p.amount, b.close,
         row_number() OVER (ORDER BY p.signal_date, p.symbol, p.side) AS turn
       FROM plain_log p JOIN bars b ON b.symbol = p.symbol AND b.date = p.signal_date WHERE p.risk_approved AND b.close > 0""",
)
sql_table(
    "plain_steps",
    """SELECT 0::BIGINT AS turn, NULL::DATE AS date, 100000.0::DOUBLE AS cash, MAP {}::MAP(VARCHAR, DOUBLE) AS owned,
         NULL::VARCHAR AS symbol, NULL::VARCHAR AS side, false AS executed
       UNION ALL
       SELECT r.turn, r.date,
         CASE WHEN r.side = 'SELL' THEN s.cash + coalesce(s.owned[r.symbol], 0) * close
              WHEN amount <= s.cash THEN s.cash - amount ELSE s.cash END,
         CASE WHEN r.side = 'SELL' THEN map_concat(s.owned, MAP {r.symbol: 0.0::DOUBLE})
              WHEN amount <= s.cash THEN map_concat(s.owned, MAP {r.symbol: coalesce(s.owned[r.symbol], 0) + amount / close})
              ELSE s.owned END,
         r.symbol, r.side, CASE WHEN r.side = 'SELL' THEN coalesce(s.owned[r.symbol], 0) > 0 ELSE amount <= s.cash END
       FROM plain_steps s JOIN plain_rows r ON r.turn = s.turn + 1""",
)
query(
    "m1_plain_log",
    "date:d symbol:t side:t executed:b cash_after:4",
    _plain_replay,
    "SELECT *, cash AS cash_after FROM plain_steps WHERE turn > 0",
)
query(
    "m1_equity_curve",
    "account:t date:d cash:4 value:4",
    lambda spark, sf: _history(spark, sf).equity_curve,
    "SELECT * FROM replay_equity",
)
query(
    "m1_positions",
    "account:t date:d symbol:t shares:6",
    lambda spark, sf: _history(spark, sf).positions,
    "SELECT * FROM replay_positions",
)


def _without_orders(desk):
    orders, panel, capital = desk.replay_inputs
    return replay.build_equity_curve(orders.withColumn("side", F.lit("NONE")), panel, capital)


query(
    "m2_flat_curve",
    "account:t date:d cash:4 value:4",
    lambda spark, sf: _without_orders(inputs.Desk(spark, sf)).equity_curve,
    "SELECT account, date, balance / 2 AS cash, balance / 2 AS value FROM accounts_t CROSS JOIN sim_days",
)

sql_table("benchmark_t", "SELECT date, avg(close) AS close FROM bars GROUP BY date")
query(
    "m3_weekly_returns",
    "account:t week_end:d weekly_return:8",
    lambda spark, sf: replay.weekly_returns(_history(spark, sf).equity_curve),
    """SELECT account, week_end, value / prev - 1 AS weekly_return FROM (
         SELECT *, lag(value) OVER (PARTITION BY account ORDER BY week_end) AS prev FROM (
           SELECT account, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS week_end, arg_max(value, date) AS value
           FROM replay_equity GROUP BY ALL)) WHERE prev IS NOT NULL""",
)
_RETURNS = "SELECT account, date, value / lag(value) OVER (PARTITION BY account ORDER BY date) - 1 AS re, close / lag(close) OVER (PARTITION BY account ORDER BY date) - 1 AS rb FROM replay_equity JOIN benchmark_t USING (date)"
sql_table("replay_returns", f"SELECT * FROM ({_RETURNS}) WHERE re IS NOT NULL")
sql_table(
    "stats_t",
    f"""SELECT *, cagr - benchmark_cagr AS excess_return, 'portfolio' AS label, 'benchmark' AS benchmark_label
        FROM ({summary_sql('replay_returns', 're', 'account')}) JOIN ({summary_sql('replay_returns', 'rb', 'account', prefix='benchmark_')}) USING (account)
        JOIN (SELECT account, min(date) AS start_date, max(date) AS end_date, max(date) - min(date) AS n_days FROM replay_equity GROUP BY account) USING (account)""",
)
_STATS = " ".join(f"{m}:6" for m in replay.STAT_METRICS)


def _stats(spark, sf):
    desk = inputs.Desk(spark, sf)
    return replay.compute_portfolio_stats(desk.history.equity_curve, desk.benchmark)


query(
    "m4_portfolio_stats",
    "account:t label:t benchmark_label:t start_date:d end_date:d n_days:i "
    + _STATS
    + " "
    + " ".join(f"benchmark_{m}:6" for m in replay.STAT_METRICS)
    + " excess_return:6",
    _stats,
    "SELECT * FROM stats_t",
)
query(
    "m5_positions_snapshot",
    "account:t date:d symbol:t shares:6 cash:4 total:4",
    lambda spark, sf: replay.positions_snapshot(_history(spark, sf)),
    """SELECT e.account, e.date, p.symbol, p.shares, e.cash, e.value AS total FROM replay_equity e
       LEFT JOIN replay_positions p ON p.account = e.account AND p.date = e.date
       WHERE e.date = (SELECT max(date) FROM bars)""",
)


def _normalised(desk):
    return replay.normalised_curves(desk.history.equity_curve, desk.benchmark)


query(
    "p5_normalised_curves",
    "account:t date:d strategy:6 benchmark:6",
    lambda spark, sf: _normalised(inputs.Desk(spark, sf)),
    """SELECT account, date, value / first_value(value) OVER w AS strategy, close / first_value(close) OVER w AS benchmark
       FROM replay_equity JOIN benchmark_t USING (date) WINDOW w AS (PARTITION BY account ORDER BY date)""",
)
query(
    "p6_report_rows",
    "account:t metric:t strategy:6 benchmark:6",
    lambda spark, sf: replay.report_rows(_stats(spark, sf)),
    " UNION ALL ".join(
        f"SELECT account, '{m}' AS metric, {m} AS strategy, benchmark_{m} AS benchmark FROM stats_t"
        for m in replay.STAT_METRICS
    ),
)
