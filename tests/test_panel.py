"""Features, targets, splits, checks and long-history windows on small panels."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import history
from barloom.operators import features, quality, splits, targets
from barloom.sources import bars as src
from tests.conftest import business_days, column, walk


def test_daily_and_lagged_returns(make_bars):
    b = make_bars({"A": [100.0, 110.0, 99.0, 99.0]})
    assert column(features.daily_returns(b), "daily_return") == [None, pytest.approx(0.1), pytest.approx(-0.1), 0.0]
    assert column(features.lagged_returns(b, 1), "lagged_return") == [None, None, pytest.approx(0.1), pytest.approx(-0.1)]
    assert column(features.log_returns(b), "log_return")[1] == pytest.approx(math.log(1.1))


def test_zero_price_gives_null_not_error(make_bars):
    b = make_bars({"A": [0.0, 5.0, 10.0]})
    assert column(features.daily_returns(b), "daily_return") == [None, None, 1.0]


def test_window_needs_all_values(make_bars):
    b = make_bars({"A": [1.0, 2.0, 3.0, 4.0]})
    assert column(features.rolling_mean(b, 3), "rolling_mean") == [None, None, 2.0, 3.0]
    vol = column(features.rolling_volatility(make_bars({"A": walk(8, 1)}), 3), "rolling_volatility")
    assert vol[:3] == [None] * 3 and vol[3] is not None


def test_rsi_all_gains(make_bars):
    b = make_bars({"A": [float(i) for i in range(1, 8)]})
    assert set(column(features.rsi(b, 3), "rsi")) == {None}
    assert column(features.rsi(b, 3, saturate=True), "rsi") == [None] * 3 + [100.0] * 4


def test_rsi_value(make_bars):
    b = make_bars({"A": [10.0, 12.0, 11.0, 13.0]})
    assert column(features.rsi(b, 3), "rsi")[3] == pytest.approx(100 - 100 / (1 + 4.0 / 1.0))


def test_short_must_be_below_long(make_bars):
    b = make_bars({"A": [1.0]})
    for op in (features.sma_ratio, features.rolling_vol_ratio):
        with pytest.raises(ValueError):
            op(b, 20, 20)


def test_features_do_not_look_ahead(make_bars):
    closes = {"A": walk(80, 2), "B": walk(80, 3)}
    cut = business_days(60)[-1]
    whole = features.build_features(make_bars(closes)).filter(F.col("date") <= F.lit(cut))
    short = features.build_features(make_bars({k: v[:60] for k, v in closes.items()}))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, short.collect()))


def test_targets(make_bars):
    b = make_bars({"A": [100.0, 100.0, 101.0, 100.9, 99.0, 98.0, 97.0]})
    assert column(targets.next_day_direction(b), "target_direction") == [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, None]
    assert column(targets.next_5day_direction(b), "target_direction_5d") == [0.0, 0.0] + [None] * 5
    assert column(targets.threshold_direction(b), "target_threshold") == [None, 1.0, None, 0.0, 0.0, 0.0, None]
    with pytest.raises(ValueError):
        targets.make_dataset(b, "other")


def test_dataset_drops_incomplete_rows(make_bars):
    b = make_bars({"A": walk(40, 4)})
    assert targets.make_dataset(b).count() == 40 - 20 - 1
    assert targets.make_dataset(b, "direction_5d").count() == 40 - 20 - 5
    assert targets.make_dataset(b, "direction_5d", keep_unlabelled=True).count() == 20


def test_time_split(make_bars):
    b = make_bars({"A": [float(i + 1) for i in range(30)]})
    days = business_days(30)
    labelled = splits.train_val_test_split(b, str(days[9]), str(days[19]))
    assert {r["split"]: r["count"] for r in labelled.groupBy("split").count().collect()} == {"train": 10, "val": 10, "test": 10}
    splits.require_all_parts(labelled)
    with pytest.raises(ValueError):
        splits.train_val_test_split(b, "2020-02-01", "2020-01-01")
    with pytest.raises(ValueError):
        splits.require_all_parts(splits.train_val_test_split(b, "2019-01-01", str(days[19])))


def test_folds(make_bars):
    b = make_bars({"A": [1.0] * 40, "B": [1.0] * 10})
    sp = splits.WalkForwardSplit(n_splits=3, min_train_size=10, test_size=5, gap=2)
    rows = splits.walk_forward_folds(b, sp).collect()
    assert {r["symbol"] for r in rows} == {"A"}
    for k in range(3):
        train = sorted(r["pos"] for r in rows if r["fold"] == k and r["role"] == "train")
        test = sorted(r["pos"] for r in rows if r["fold"] == k and r["role"] == "test")
        assert train == list(range(10 + 5 * k))
        assert test == list(range(12 + 5 * k, 17 + 5 * k))
    assert [(r["symbol"], r["n"]) for r in splits.short_histories(b, sp).collect()] == [("B", 10)]


def test_splitter_arguments():
    for bad in ({"n_splits": 0}, {"test_size": 0}, {"min_train_size": 0}, {"gap": -1}, {"anchor": "middle"}):
        with pytest.raises(ValueError):
            splits.WalkForwardSplit(**bad)


@pytest.mark.parametrize("block", [32, 64])
def test_blocked_history_equals_plain(spark, make_bars, block):
    daily = make_bars({"A": walk(150, 5), "B": walk(90, 6)})
    timed = daily.withColumn("date", F.col("date").cast("timestamp_ntz"))
    kw = dict(keys=["symbol"], back=21, ahead=5)
    stages = [*features.feature_stages(), lambda w: {"y": targets.target_column(w, "direction_5d")}]
    plain = history.over_history(daily.select("symbol", "date", "close"), *stages, **kw)
    cut = history.over_history(timed.select("symbol", "date", "close"), *stages, block_rows=block, **kw)
    cut = cut.withColumn("date", F.to_date("date")).select(plain.columns)

    def rows(df):
        return sorted(tuple(None if v is None else v if isinstance(v, (str, dt.date)) else round(v, 10) for v in r) for r in df.collect())

    assert rows(plain) == rows(cut)
    assert "Window" in cut._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        history.over_history(timed, *stages, keys=["symbol"], back=100, block_rows=50)


def test_running_totals_in_two_levels(spark):
    rows = [("a", dt.date(2024, 1, 1 + i // 3), i, float(i % 4) - 1.0 or None) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, day date, seq int, v double")
    outs = {"s": ("sum", "v"), "m": ("max", "v")}
    two = history.running(df, outs, keys=["k"], order=["day", "seq"], block="day").orderBy("seq").collect()
    total, top = None, None
    for r in two:
        if r["v"] is not None:
            total = r["v"] if total is None else total + r["v"]
            top = r["v"] if top is None else max(top, r["v"])
        assert (r["s"], r["m"]) == (total, top)


@pytest.mark.parametrize("backwards", [False, True])
def test_last_known_value_in_two_levels(spark, backwards):
    # whole days without a value, nulls between values, a key without any
    values = [None, None, 3.0, None, None, None, None, None, None, 5.0, None, 7.0, None, None, None]
    rows = [("a", dt.date(2024, 1, 1 + i // 3), i, v) for i, v in enumerate(values)]
    rows += [("b", dt.date(2024, 1, 1 + i), i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, day date, seq int, v double")
    out = history.running(df, {"l": ("last", "v")}, keys=["k"], order=["day", "seq"], block="day", backwards=backwards)
    got = {(r["k"], r["seq"]): r["l"] for r in out.collect()}
    known, wanted = None, {("b", i): None for i in range(3)}
    for i in sorted(range(len(values)), reverse=backwards):
        known = known if values[i] is None else values[i]
        wanted["a", i] = known
    assert got == wanted


def test_validate_bars(spark, make_bars):
    good = make_bars({"A": [1.0, 2.0]})
    assert quality.validate_bars(good) is good
    for bad in (
        good.unionByName(good.limit(1)),
        good.withColumn("close", F.lit(None).cast("double")),
        good.withColumn("high", F.col("low") - 1),
    ):
        with pytest.raises(ValueError):
            quality.validate_bars(bad)
    with pytest.raises(ValueError):
        quality.validate_bars(good.drop("volume"))


def test_bar_table_round_trip_and_pruning(spark, make_bars, tmp_path):
    path = str(tmp_path / "bars")
    src.write_bars(make_bars({"A": [1.0, 2.0, 3.0], "B": [5.0, 6.0, 7.0]}), path)
    src.write_bars(make_bars({"B": [8.0]}), path)  # replaces only B
    assert src.read_bars(spark, path).count() == 4
    scan = src.read_bars(spark, path, symbols=["A"], start="2020-01-02", end="2020-01-02").select("symbol", "close")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [symbol" in plan.replace("isnotnull(symbol#", "symbol#") or "symbol" in plan.split("PartitionFilters")[1]
    assert "PushedFilters: [IsNotNull(date)" in plan
    assert "ReadSchema: struct<date:date,close:double>" in plan
    assert [tuple(r) for r in scan.collect()] == [("A", 2.0)]


def test_one_sort_serves_features_and_target(make_bars):
    plan = targets.make_dataset(make_bars({"A": walk(40, 7)}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_ticks_are_reduced_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "ticks")
    rows = [("A", dt.date(2024, 1, 1 + i % 3), float(i), i, "unused") for i in range(300)]
    spark.createDataFrame(rows, "s string, d date, p double, n int, x string").write.parquet(path)
    bars = src.bars_from_ticks(
        spark.read.parquet(path), symbol=F.col("s"), time=F.col("d"), price=F.col("p"), sequence=F.col("n")
    )
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_min_by") < plan.index("FileScan")
    assert "ReadSchema: struct<s:string,d:date,p:double,n:int>" in plan
    first = bars.orderBy("date").first()
    assert (first["open"], first["high"], first["low"], first["close"], first["volume"]) == (0.0, 297.0, 0.0, 297.0, 100.0)


def test_empty_results_can_be_refused(make_bars):
    b = make_bars({"A": [1.0]})
    assert quality.require_rows(b, "bars") is b
    with pytest.raises(ValueError):
        quality.require_rows(b.filter("close > 5"), "bars")


def test_scan_validates_what_it_reads(spark, make_bars, tmp_path):
    from barloom.operators.quality import sound_bars
    from barloom.sources.bars import read_bars, write_bars

    bars = make_bars({"A": [1.0, 2.0, 3.0], "B": [1.0, 2.0, 3.0]})
    broken = bars.withColumn("high", F.when((F.col("symbol") == "B") & (F.col("close") == 3.0), 0.0).otherwise(F.col("high")))
    write_bars(broken, str(tmp_path / "bars"))
    with pytest.raises(ValueError, match="B: high_below_low in 1 row"):
        read_bars(spark, str(tmp_path / "bars"), validate=True)
    # the broken day lies outside the slice, the other symbol is sound
    last = max(r["date"] for r in bars.select("date").collect())
    assert read_bars(spark, str(tmp_path / "bars"), end=str(last - __import__("datetime").timedelta(days=1)), validate=True).count() == 4
    assert read_bars(spark, str(tmp_path / "bars"), ["A"], validate=True).count() == 3
    sound, reasons = sound_bars(read_bars(spark, str(tmp_path / "bars")))
    assert {r["symbol"] for r in sound.collect()} == {"A"}
    assert [tuple(r) for r in reasons.collect()] == [("B", "high_below_low", 1)]
