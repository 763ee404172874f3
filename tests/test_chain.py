"""The weekly routine end to end, and the order stream."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import replay
from barloom.operators.models import PreviousDirection
from barloom.operators.orders import RiskConfig
from barloom.operators.splits import WalkForwardSplit
from barloom.plans import weekly
from barloom.sources import order_log
from barloom.streaming.order_stream import stream_order_log
from barloom.streaming.weekly_stream import stream_weekly_values, streamed_weekly_returns
from tests.conftest import business_days, walk

SETTINGS = weekly.DeskSettings(
    model=PreviousDirection(),
    splitter=WalkForwardSplit(2, 100, 30, 1, anchor="end"),
    top_n=2,
    min_score=0.5,
    min_score_downtrend=0.5,
    risk=RiskConfig(max_positions=2),
)


def test_weekly_routine(spark, make_bars, tmp_path):
    days = business_days(260)
    bars = make_bars({s: walk(260, i) for i, s in enumerate("ABCDE")}, days)
    signals, orders, state, state2 = (str(tmp_path / n) for n in ("signals", "orders", "s1", "s2"))
    none = spark.createDataFrame([], "symbol string")
    for day in (days[200], days[207]):
        ranking = weekly.write_weekly_signals(bars, none, str(day), signals, SETTINGS)
    assert ranking.count() == 5
    accounts = spark.createDataFrame([("x",), ("y",)], "account string")
    books = spark.createDataFrame([(a, s) for a in "xy" for s in "ABCDE"], "account string, symbol string")
    plan = weekly.propose_and_log_orders(spark, signals, state, state2, orders, books, SETTINGS, generated_at=f"{days[207]}T21:00:00+00:00")
    bought = {r["symbol"] for r in plan.filter("risk_approved and account = 'x'").collect()}
    wanted = {r["symbol"] for r in ranking.orderBy(F.desc("score"), "symbol").filter("score >= 0.5").limit(2).collect()}
    assert bought == wanted and bought
    assert plan.select("signal_date").distinct().first()[0] == days[207]
    logged = order_log.load_orders(spark, orders).count()
    weekly.propose_and_log_orders(spark, signals, state, str(tmp_path / "s3"), orders, books, SETTINGS, generated_at=f"{days[207]}T21:00:00+00:00")
    assert order_log.load_orders(spark, orders).count() == logged == 2 * len(bought)
    # with the new state, the held symbols are not sold and nothing more may be opened
    again = weekly.propose_and_log_orders(
        spark, signals, state2, str(tmp_path / "s4"), str(tmp_path / "o2"), books, SETTINGS
    )
    assert again.filter("risk_approved").count() == 0 or len(bought) < 2
    enriched, summaries = weekly.analyse_signal_log(spark, signals, bars)
    assert enriched.count() == 10 and enriched.filter("return_5d_forward is null").count() == 0
    assert {r["summary"] for r in summaries.collect()} == {"action", "action_sma", "action_bucket"}
    benchmark = bars.groupBy("date").agg(F.avg("close").alias("close"))
    capital = accounts.withColumn("capital", F.lit(10_000.0))
    assert weekly.order_log_report(spark, orders, bars, benchmark, capital).count() == 2
    result, stats = weekly.simulated_report(bars, benchmark, SETTINGS)
    assert result.equity_curve.count() == 260 and stats.count() == 1


def test_order_stream_adds_each_id_once(spark, tmp_path):
    plan = spark.createDataFrame(
        [("x", i, dt.date(2024, 5, 10), s, "BUY", 5.0, 0.6, "", True, "", "") for i, s in enumerate("ABA")],
        "account string, seq long, signal_date date, symbol string, side string, amount double, score double, "
        "signal_reason string, risk_approved boolean, risk_rule string, risk_reason string",
    )
    inbox, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    for _ in range(2):
        order_log.order_records(plan).write.mode("append").json(inbox)
        stream_order_log(spark, inbox, log, checkpoint).awaitTermination()
    assert sorted(r["order_id"] for r in order_log.read_order_records(spark, log).collect()) == [
        "2024-05-10:A:BUY",
        "2024-05-10:B:BUY",
    ]


def test_streamed_weekly_returns_equal_the_batch_operator(spark, tmp_path):
    """Rows arrive day by day, repeated and a little late; a gap of weeks and a zero are passed over."""
    schema = "account string, date date, cash double, value double"
    start = dt.date(2024, 1, 1)
    rows = [
        (account, start + dt.timedelta(days=d), 0.0, value)
        for account, first in (("a", 100.0), ("b", 250.0))
        for d, value in ((d, 0.0 if d == 25 else first + (d * 7) % 23) for d in range(60) if account == "a" or not 20 <= d < 41)
        if (start + dt.timedelta(days=d)).weekday() < 5
    ]
    batches = [[r for r in rows if (r[1] - start).days // 15 == n] for n in range(4)]
    batches[1], batches[2] = batches[1] + batches[0][-3:], batches[2] + batches[1][-2:]
    end = [(account, dt.date(2024, 6, 3), 0.0, 1.0) for account in "ab"]
    incoming, out = str(tmp_path / "equity"), str(tmp_path / "weekly")
    for batch in [*batches, end]:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(incoming)
        equity = spark.readStream.schema(schema).parquet(incoming)
        stream_weekly_values(equity, out, str(tmp_path / "checkpoint")).awaitTermination()
    wanted = replay.weekly_returns(spark.createDataFrame(rows, schema)).collect()
    got = streamed_weekly_returns(spark, out).collect()
    assert len(wanted) > 10
    key = lambda r: (r["account"], r["week_end"])
    assert [(*key(r), pytest.approx(r["weekly_return"])) for r in sorted(wanted, key=key)] == [
        (*key(r), r["weekly_return"]) for r in sorted(got, key=key)
    ]
