"""Bars, checks, splits, features and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import features as fe
from barloom.operators import quality, splits
from barloom.operators import targets as ta
from barloom.plans import inputs
from barloom.session import shared_dir
from barloom.sources import bars as src
from catalog.base import SYM, complete, features_sql, full, query, sql_table

BAR = "symbol:t date:d open:8 high:8 low:8 close:8 volume:8"
HOURLY = BAR.replace("date:d", "date:n")

# --- sources ---------------------------------------------------------------

query("x1_bars_from_orders", BAR, inputs.bars, "SELECT * FROM bars")

sql_table(
    "hourly",
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS date, arg_min(px, ts) AS open, max(px) AS high,
       min(px) AS low, arg_max(px, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
       FROM (SELECT *, 100 + value / 250 AS px FROM events) GROUP BY 1, 2""",
)
query("x1_hourly_bars_from_events", HOURLY, inputs.hourly_bars, "SELECT * FROM hourly")


def _stored(spark, sf):
    path = shared_dir(spark, "bars")
    src.write_bars(inputs.bars(spark, sf), path)
    return path


query(
    "a1_bar_scan",
    BAR,
    lambda spark, sf: src.read_bars(
        spark, _stored(spark, sf), symbols=["1-URGENT", "5-LOW"], start="1996-01-01", end="2000-06-30"
    ),
    """SELECT * FROM bars WHERE symbol IN ('1-URGENT', '5-LOW')
       AND date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'""",
)


def _raw_download(spark, sf):
    stamp = F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL '21:30' HOUR TO MINUTE")
    b = inputs.bars(spark, sf)
    return b.select(
        F.col("symbol").alias("Symbol"),
        stamp.alias("Date"),
        *[F.col(c).alias(f"{c.capitalize()}/X") for c in src.PRICE_COLUMNS],
        F.lit(1.0).alias("Adj Close"),
    )


query(
    "a2_normalise",
    BAR,
    lambda spark, sf: src.normalise_bars(_raw_download(spark, sf), zone="America/New_York"),
    "SELECT * REPLACE (date + 1 AS date) FROM bars",
)
query(
    "a3_date_slice",
    BAR,
    lambda spark, sf: src.slice_dates(inputs.bars(spark, sf), "1997-03-03", "1999-12-31"),
    "SELECT * FROM bars WHERE date BETWEEN DATE '1997-03-03' AND DATE '1999-12-31'",
)
query(
    "a4_bar_sink",
    "symbol:t n_bars:l first_date:d last_date:d volume:4",
    lambda spark, sf: src.read_bars(spark, _stored(spark, sf))
    .groupBy("symbol")
    .agg(
        F.count("*").alias("n_bars"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("volume").alias("volume"),
    ),
    """SELECT symbol, count(*) AS n_bars, min(date) AS first_date, max(date) AS last_date, sum(volume) AS volume
       FROM bars GROUP BY symbol""",
)

# --- checks ----------------------------------------------------------------


def _dirty(spark, sf):
    b = inputs.bars(spark, sf)
    again = b.filter(F.dayofmonth("date") == 1).withColumns(
        {"high": F.col("low") - 1, "volume": F.when(F.month("date") != 6, F.col("volume"))}
    )
    return b.unionByName(again)


query(
    "b1_validate_bars",
    "symbol:t n_rows:l duplicate_dates:l null_rows:l high_below_low:l",
    lambda spark, sf: quality.bar_violations(_dirty(spark, sf)),
    """WITH dirty AS (SELECT * FROM bars UNION ALL
         SELECT symbol, date, open, low - 1 AS high, low, close, CASE WHEN month(date) <> 6 THEN volume END
         FROM bars WHERE day(date) = 1)
       SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT date) AS duplicate_dates,
         count(*) FILTER (WHERE volume IS NULL) AS null_rows, count(*) FILTER (WHERE high < low) AS high_below_low
       FROM dirty GROUP BY symbol""",
)

# one symbol clean, the others each with the days that break a rule
_PARTLY = "SELECT * REPLACE (CASE WHEN symbol = '2-HIGH' AND day(date) = 1 THEN low - 1 ELSE high END AS high, CASE WHEN symbol = '3-MEDIUM' AND month(date) = 6 THEN NULL ELSE volume END AS volume) FROM bars"


def _partly_dirty(spark, sf):
    path = shared_dir(spark, "dirty")
    bars = inputs.bars(spark, sf)
    high = F.when((F.col("symbol") == "2-HIGH") & (F.dayofmonth("date") == 1), F.col("low") - 1).otherwise(F.col("high"))
    volume = F.when(~((F.col("symbol") == "3-MEDIUM") & (F.month("date") == 6)), F.col("volume"))
    src.write_bars(bars.withColumns({"high": high, "volume": volume}), path)
    return src.read_bars(spark, path)


query(
    "a1_scan_reasons",
    "symbol:t reason:t n:l",
    lambda spark, sf: quality.broken_symbols(_partly_dirty(spark, sf)),
    f"""WITH dirty AS ({_PARTLY})
        SELECT symbol, 'high_below_low' AS reason, count(*) AS n FROM dirty WHERE high < low GROUP BY symbol UNION ALL
        SELECT symbol, 'null_rows', count(*) FROM dirty WHERE volume IS NULL GROUP BY symbol""",
)
query(
    "a1_sound_scan",
    BAR,
    lambda spark, sf: quality.sound_bars(_partly_dirty(spark, sf))[0],
    "SELECT * FROM bars WHERE symbol NOT IN ('2-HIGH', '3-MEDIUM')",
)

# --- splits ----------------------------------------------------------------

query(
    "c1_train_val_test_split",
    "symbol:t split:t n:l first_date:d last_date:d",
    lambda spark, sf: splits.train_val_test_split(inputs.bars(spark, sf), "1998-12-31", "2000-03-31")
    .groupBy("symbol", "split")
    .agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")),
    """SELECT symbol, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '2000-03-31' THEN 'val'
         ELSE 'test' END AS split, count(*) AS n, min(date) AS first_date, max(date) AS last_date
       FROM bars GROUP BY 1, 2""",
)

FOLD = "symbol:t date:d pos:l fold:i role:t"
_FOLD_SQL = """
    WITH p AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos,
                 count(*) OVER (PARTITION BY symbol) AS n FROM bars),
      k AS (SELECT symbol, n, {first} AS first_train, {folds} AS folds FROM (SELECT DISTINCT symbol, n FROM p)),
      f AS (SELECT symbol, first_train, unnest(range(folds)) AS fold FROM k WHERE n >= {need})
    SELECT symbol, date, pos, fold, 'train' AS role FROM p JOIN f USING (symbol) WHERE pos < first_train + fold * 63
    UNION ALL
    SELECT symbol, date, pos, fold, 'test' FROM p JOIN f USING (symbol)
    WHERE pos >= first_train + fold * 63 + 1 AND pos < first_train + fold * 63 + 1 + 63"""

query(
    "c2_walk_forward_folds",
    FOLD,
    lambda spark, sf: splits.walk_forward_folds(inputs.bars(spark, sf), inputs.SPLITTER),
    _FOLD_SQL.format(first="252", folds="5", need="252 + 5 * 63 + 1"),
)
query(
    "c2_walk_forward_folds_end",
    FOLD,
    lambda spark, sf: splits.walk_forward_folds(
        inputs.bars(spark, sf), splits.WalkForwardSplit(5, 252, 63, 1, anchor="end")
    ),
    _FOLD_SQL.format(first="252 + n - (252 + 5 * 63 + 1)", folds="5", need="252 + 5 * 63 + 1"),
)
query(
    "c3_adaptive_folds",
    FOLD,
    lambda spark, sf: splits.walk_forward_folds(inputs.bars(spark, sf), splits.AdaptiveSplit()),
    _FOLD_SQL.format(
        first="CASE WHEN n < 800 THEN 252 ELSE 504 END",
        folds="least(8, (n - CASE WHEN n < 800 THEN 252 ELSE 504 END - 1) // 63)",
        need="first_train + 63 + 1",
    ),
)

# --- features --------------------------------------------------------------

_RET = f"(SELECT *, close / lag(close) OVER ({SYM}) - 1 AS r FROM bars)"


def _feature(name: str, col: str, run, sql: str) -> None:
    query(name, f"symbol:t date:d {col}:8", lambda spark, sf: run(inputs.bars(spark, sf)), sql)


_feature(
    "d1_daily_returns", "daily_return", fe.daily_returns, f"SELECT symbol, date, r AS daily_return FROM {_RET}"
)
_feature(
    "d2_log_returns",
    "log_return",
    fe.log_returns,
    f"SELECT symbol, date, ln(close / lag(close) OVER ({SYM})) AS log_return FROM bars",
)
_feature(
    "d3_lagged_returns",
    "lagged_return",
    lambda b: fe.lagged_returns(b, 3),
    f"SELECT symbol, date, lag(r, 3) OVER ({SYM}) AS lagged_return FROM {_RET}",
)
_feature(
    "d4_rolling_mean",
    "rolling_mean",
    lambda b: fe.rolling_mean(b, 50),
    f"SELECT symbol, date, {full('avg', 'close', 50)} AS rolling_mean FROM bars",
)
_feature(
    "d5_rolling_volatility",
    "rolling_volatility",
    lambda b: fe.rolling_volatility(b, 20),
    f"SELECT symbol, date, {full('stddev_samp', 'r', 20)} AS rolling_volatility FROM {_RET}",
)
_feature(
    "d6_sma_ratio",
    "sma_ratio",
    lambda b: fe.sma_ratio(b, 10, 50),
    f"SELECT symbol, date, ({full('avg', 'close', 10)}) / ({full('avg', 'close', 50)}) AS sma_ratio FROM bars",
)
_feature(
    "d7_rolling_vol_ratio",
    "vol_ratio",
    lambda b: fe.rolling_vol_ratio(b, 5, 60),
    f"SELECT symbol, date, ({full('stddev_samp', 'r', 5)}) / ({full('stddev_samp', 'r', 60)}) AS vol_ratio FROM {_RET}",
)
_feature(
    "d8_price_vs_mean",
    "price_vs_mean",
    lambda b: fe.price_vs_mean(b, 200),
    f"""SELECT symbol, date, (close - ({full('avg', 'close', 200)})) / ({full('avg', 'close', 200)}) AS price_vs_mean
        FROM bars""",
)
_MOVES = f"""(SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS gain,
    CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS loss
    FROM (SELECT *, close - lag(close) OVER ({SYM}) AS d FROM bars))"""


def _rsi_sql(n: int, saturate: bool) -> str:
    top = "WHEN l = 0 AND g > 0 THEN 100.0" if saturate else ""
    return f"""SELECT symbol, date, CASE {top} WHEN true THEN 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi
        FROM (SELECT symbol, date, {full('avg', 'gain', n)} AS g, {full('avg', 'loss', n)} AS l FROM {_MOVES})"""


_feature("d9_rsi", "rsi", fe.rsi, _rsi_sql(14, False))
_feature("d9_rsi_short_saturated", "rsi", lambda b: fe.rsi(b, 3, saturate=True), _rsi_sql(3, True))

sql_table("feats", features_sql("bars"))
ALL_FEATURES = " ".join(f"{c}:8" for c in fe.FEATURE_COLUMNS)
query(
    "d10_build_features",
    f"symbol:t date:d {ALL_FEATURES}",
    lambda spark, sf: fe.build_features(inputs.bars(spark, sf)),
    "SELECT * FROM feats",
)
query(
    "d10_build_features_hourly",
    f"symbol:t date:n {ALL_FEATURES}",
    lambda spark, sf: fe.build_features(inputs.hourly_bars(spark, sf)),
    features_sql("hourly"),
)

# --- targets ---------------------------------------------------------------

_NEXT = f"lead(close) OVER ({SYM})"


def _target(name: str, col: str, run, expr: str) -> None:
    query(
        name,
        f"symbol:t date:d {col}:8",
        lambda spark, sf: run(inputs.bars(spark, sf)),
        f"SELECT symbol, date, {expr} AS {col} FROM bars",
    )


_DIRECTION = f"CAST({_NEXT} > close AS DOUBLE)"
_THRESHOLD = (
    f"CASE WHEN {_NEXT} / close - 1 > 0.005 THEN 1.0 WHEN {_NEXT} / close - 1 < -0.005 THEN 0.0 END"
)
_target("e1_next_day_direction", "target_direction", ta.next_day_direction, _DIRECTION)
_target("e2_next_day_return", "target_return", ta.next_day_return, f"{_NEXT} / close - 1")
_target(
    "e3_next_5day_direction",
    "target_direction_5d",
    ta.next_5day_direction,
    f"CAST(lead(close, 5) OVER ({SYM}) > close AS DOUBLE)",
)
_target("e4_threshold_target", "target_threshold", ta.threshold_direction, _THRESHOLD)

FULL = complete(fe.FEATURE_COLUMNS)
sql_table("ds_direction", f"SELECT * FROM (SELECT *, {_DIRECTION} AS y FROM feats) WHERE {FULL} AND y IS NOT NULL")
sql_table("ds_return", f"SELECT * FROM (SELECT *, {_NEXT} / close - 1 AS y FROM feats) WHERE {FULL} AND y IS NOT NULL")
sql_table("ds_threshold", f"SELECT * FROM (SELECT *, {_THRESHOLD} AS y FROM feats) WHERE {FULL} AND y IS NOT NULL")

for _name in ("direction", "threshold", "return"):
    query(
        f"e5_make_dataset_{_name}",
        f"symbol:t date:d {ALL_FEATURES} y:8",
        lambda spark, sf, t=_name: ta.make_dataset(inputs.bars(spark, sf), t),
        f"SELECT * FROM ds_{_name}",
    )
