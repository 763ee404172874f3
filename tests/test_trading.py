"""Signals, logs, orders, replay and rebalancing, against hand values and plain loops."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import forward_returns as fr
from barloom.operators import orders as od
from barloom.operators import rebalance, replay, signals
from barloom.sources import account_state, order_log, signal_log
from tests.conftest import business_days, walk

DAY = dt.date(2024, 5, 10)


def _ranking(spark, rows):
    return spark.createDataFrame(
        [(DAY, *r) for r in rows], "as_of date, symbol string, score double, above_sma_200 boolean"
    )


def _held(spark, symbols):
    return spark.createDataFrame([(DAY, s) for s in symbols], "as_of date, symbol string")


def _actions(df):
    return {r["symbol"]: r["action"] for r in df.collect()}


def test_signal_rules(spark):
    ranking = _ranking(
        spark,
        [
            ("A", 0.70, True),
            ("B", 0.60, False),  # down and below the strict limit: blocked
            ("C", 0.62, False),  # down, exactly at the strict limit: eligible
            ("D", 0.55, None),  # unknown trend is neutral, exactly at the limit
            ("E", 0.549, True),
            ("F", None, True),
        ],
    )
    out = signals.generate_signals(ranking, _held(spark, ["C", "E", "Z"]), top_n=3)
    assert _actions(out) == {"A": "buy", "B": "blocked", "C": "hold", "D": "buy", "E": "sell", "Z": "sell"}
    ordered = [(r["action"], r["symbol"]) for r in signals.order_signals(out).collect()]
    assert ordered == [("buy", "A"), ("buy", "D"), ("hold", "C"), ("sell", "E"), ("sell", "Z"), ("blocked", "B")]
    blocked = signals.generate_signals(ranking, _held(spark, ["B"]), top_n=3).filter("symbol = 'B'").first()
    assert blocked["action"] == "sell"
    assert blocked["reason"] == "blocked: below SMA200 and score 0.600 < min_score_downtrend 0.62"


def test_blocked_rows_leave_the_slot(spark):
    ranking = _ranking(spark, [("A", 0.61, False), ("B", 0.58, True)])
    assert _actions(signals.generate_signals(ranking, _held(spark, []), top_n=1)) == {"A": "blocked", "B": "buy"}


def test_signal_arguments(spark):
    ranking = _ranking(spark, [("A", 0.6, None)])
    for bad in ({"top_n": 0}, {"min_score": 1.5}, {"min_score": 0.7, "min_score_downtrend": 0.6}):
        with pytest.raises(ValueError):
            signals.generate_signals(ranking, _held(spark, []), **bad)
    with pytest.raises(ValueError):
        signals.generate_signals(ranking.drop("score"), _held(spark, []))


def test_top_rows_prune_before_the_shuffle(spark):
    plan = signals.top_rows(_ranking(spark, [("A", 0.6, None)]), 3, ["as_of"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


# --- signal log ------------------------------------------------------------

HEADER = ",".join(signal_log.LOG_COLUMNS)


def test_signal_log_reads_plain_files(spark, tmp_path):
    (tmp_path / "2024-05-10.csv").write_text(f"{HEADER}\n2024-05-10,1,A,0.7,buy,,,,,,True\n2024-05-10,2,B,bad,,,,,,,\n")
    (tmp_path / "2024-05-17.csv").write_text(
        f"{HEADER}\n2024-05-17 00:00:00+00:00,1,A,0.6,hold,,0.1,0.2,0.3,0.4,False\n2024-05-16 23:30:00-05:00,2,C,0.5,sell,x,,,,,\n"
    )
    (tmp_path / "analysis.csv").write_text(f"{HEADER}\n2020-01-01,1,Q,0.9,buy,,,,,,True\n")
    rows = {(r["file"], r["symbol"]): r for r in signal_log.read_signal_log(spark, str(tmp_path)).collect()}
    assert len(rows) == 5 and rows[(None, "Q")]["score"] == 0.9
    assert rows["2024-05-10", "B"]["score"] is None and rows["2024-05-10", "B"]["action"] == "(no action)"
    assert rows["2024-05-17", "A"]["date"] == rows["2024-05-17", "C"]["date"] == dt.date(2024, 5, 17)
    assert rows["2024-05-17", "A"]["above_sma_200"] is False
    latest = signal_log.read_latest_signals(spark, str(tmp_path)).collect()
    assert {r["symbol"] for r in latest} == {"A", "C"}


def test_mixed_latest_file_is_refused(spark, tmp_path):
    (tmp_path / "2024-05-10.csv").write_text(f"{HEADER}\n2024-05-10,1,A,0.7,buy,,,,,,\n2024-05-09,1,A,0.7,buy,,,,,,\n")
    with pytest.raises(ValueError):
        signal_log.read_latest_signals(spark, str(tmp_path))


def test_session_zone_does_not_move_dates(spark, tmp_path):
    (tmp_path / "2024-05-10.csv").write_text(f"{HEADER}\n2024-05-10 00:00:00+00:00,1,A,0.7,buy,,,,,,\n2024-05-10,2,B,0.7,buy,,,,,,\n")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = signal_log.read_signal_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r["date"] for r in rows} == {DAY}


# --- forward returns -------------------------------------------------------


def test_entry_is_first_bar_on_or_after(spark, make_bars):
    bars = make_bars({"A": [10.0, 11.0, 12.0]}, [dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 9)])
    asked = spark.createDataFrame(
        [("A", dt.date(2024, 1, d)) for d in (1, 5, 6, 9, 10)] + [("X", dt.date(2024, 1, 5))], "symbol string, date date"
    )
    got = {(r["symbol"], r["date"].day): r["entry_date"] and r["entry_date"].day for r in fr.entry_bars(asked, bars).collect()}
    assert got == {("A", 1): 5, ("A", 5): 5, ("A", 6): 8, ("A", 9): 9, ("A", 10): None, ("X", 5): None}
    moved = fr.add_forward_returns(asked, bars, [1]).collect()
    assert {(r["symbol"], r["date"].day): r["return_1d_forward"] for r in moved}["A", 6] == pytest.approx(12 / 11 - 1)


def _intraday(df, days, name="date"):
    """The same rows, six to a day: the n-th date becomes the n-th of four-hourly times."""
    times = {d: dt.datetime(2024, 3, 1) + dt.timedelta(hours=4 * i) for i, d in enumerate(days)}
    at = F.create_map(*[F.lit(x) for d, t in times.items() for x in (d, t)])
    return df.withColumn(name, at[F.col(name)].cast("timestamp_ntz")), times


def test_forward_returns_of_intraday_bars_equal_those_of_days(spark, make_bars):
    days = business_days(60)
    closes = {s: [None if i % 7 in gaps else v for i, v in enumerate(walk(60, n))] for n, (s, gaps) in enumerate({"A": {1, 2}, "B": {5}, "C": set(range(7)) - {3}}.items())}
    bars = make_bars(closes, days)
    asked = spark.createDataFrame([(s, d) for s in "ABCX" for d in days[::3] for _ in range(2)], "symbol string, date date")
    daily = fr.add_forward_returns(asked, bars, (2, 9))
    (timed_asks, times), (timed_bars, _) = _intraday(asked, days), _intraday(bars, days)
    timed = fr.add_forward_returns(timed_asks, timed_bars, (2, 9))
    back = {t: d for d, t in times.items()}
    key = lambda r: (r["symbol"], r["date"], str(r[2]), str(r[3]))
    assert sorted(key(r) for r in daily.collect()) == sorted((r["symbol"], back[r["date"]], str(r[2]), str(r[3])) for r in timed.collect())
    entries = {(r["symbol"], r["date"]): r["entry_date"] for r in fr.entry_bars(asked, bars).collect()}
    found = {(r["symbol"], back[r["date"]]): back.get(r["entry_date"]) for r in fr.entry_bars(timed_asks, timed_bars).collect()}
    assert entries == found and len(entries) == 80
    plan = fr.entry_bars(timed_asks, timed_bars)._jdf.queryExecution().executedPlan().toString()
    assert "_cut" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_score_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.55, 0.599, 0.65, 1.0, 1.01, None)], "score double")
    got = [r["b"] for r in df.select(fr.score_bucket(F.col("score")).alias("b")).collect()]
    assert got == [None, "<0.55", "0.55-0.60", "0.55-0.60", ">0.65", ">0.65", None, None]


# --- orders ----------------------------------------------------------------

PLAN = "account string, seq long, symbol string, side string, amount double, score double, signal_reason string, leverage int"


def _orders(spark, rows):
    return spark.createDataFrame([(a, i, s, side, amt, 0.6, "", lev) for i, (a, s, side, amt, lev) in enumerate(rows, 1)], PLAN)


def _run_plan(spark, rows, held=(), config=od.RiskConfig(), cash=10_000.0, balance=10_000.0):
    accounts = spark.createDataFrame([("x", balance, cash)], "account string, balance double, cash double")
    positions = spark.createDataFrame([("x", h) for h in held], "account string, symbol string")
    plan = od.build_execution_plan(_orders(spark, rows), accounts, positions, config)
    return plan.orderBy("seq").collect()


def test_plan_carries_cash_and_positions(spark):
    rows = [("x", s, "BUY", 2000.0, 1) for s in "ABCDE"] + [("x", "A", "SELL", 0.0, 1), ("x", "A", "SELL", 0.0, 1)]
    got = _run_plan(spark, rows)
    assert [r["risk_rule"] for r in got] == ["", "", "", "", "cash_buffer", "", "short_sell"]
    assert got[-1]["cash_after"] == 2000.0
    assert got[4]["risk_reason"] == (
        "Insufficient cash: buying 2000.00 would leave 0.00 which is below the required 5% buffer (500.00)."
    )


def test_first_broken_rule_wins(spark):
    config = od.RiskConfig(max_positions=1, approved_universe=("A",))
    rows = [
        ("x", "B", "BUY", 9000.0, 2),
        ("x", "B", "SELL", 0.0, 1),
        ("x", "B", "BUY", 9000.0, 1),
        ("x", "H", "SELL", 0.0, 1),
        ("x", "A", "BUY", 9000.0, 1),
    ]
    got = _run_plan(spark, rows, held=["H"], config=config)
    assert [r["risk_rule"] for r in got] == ["leverage", "short_sell", "max_positions", "universe", "max_positions"]
    assert {r["risk_rule"] for r in _run_plan(spark, rows, config=od.RiskConfig(mode="real"))} == {"mode"}
    size = _run_plan(spark, [("x", "A", "BUY", 9000.0, 1)])
    assert size[0]["risk_reason"] == "Order amount 9000.00 exceeds 20% of account balance (2000.00)."


def test_plans_are_independent(spark):
    rows = [(a, s, "BUY", 2000.0, 1) for s in "ABC" for a in ("x", "y", "z")]
    accounts = spark.createDataFrame([(a, 10_000.0, c) for a, c in (("x", 1e4), ("y", 4e3), ("z", 1e3))], "account string, balance double, cash double")
    none = spark.createDataFrame([], "account string, symbol string")
    plan = od.build_execution_plan(_orders(spark, rows), accounts, none, od.RiskConfig())
    got = {r["account"]: (r["n_approved"], r["cash_after_est"]) for r in od.plan_summary(plan).collect()}
    assert got == {"x": (3, 4000.0), "y": (1, 2000.0), "z": (0, 1000.0)}


def test_apply_orders(spark):
    state = spark.createDataFrame([("x", 1000.0, {"A": 1.0, "B": 1.0}, None, None), ("y", 5.0, {}, None, None)], account_state.STATE_SCHEMA)
    approved = spark.createDataFrame(
        [("x", 1, DAY, "A", "SELL", 0.0), ("x", 2, DAY, "C", "BUY", 900.0), ("x", 3, DAY, "D", "BUY", 900.0), ("x", 4, DAY, "D", "SELL", 0.0)],
        "account string, seq long, signal_date date, symbol string, side string, amount double",
    )
    got = {r["account"]: r for r in od.apply_orders(state, approved).collect()}
    assert (got["x"]["cash"], got["x"]["positions"], got["x"]["last_signal_date"]) == (0.0, {"B": 1.0, "C": 1.0}, DAY)
    assert (got["y"]["cash"], got["y"]["positions"], got["y"]["last_signal_date"]) == (5.0, {}, None)


def test_state_defaults_for_missing_and_corrupt(spark, tmp_path):
    wanted = spark.createDataFrame([("x",), ("y",)], "account string")
    assert {r["cash"] for r in account_state.load_state(spark, str(tmp_path / "none"), wanted).collect()} == {10_000.0}
    (tmp_path / "s.json").write_text('{"account": "x", "cash": 7.5, "positions": {"A": 1.0}}\n{"account": "y", "cash": \n')
    got = {r["account"]: (r["cash"], r["positions"]) for r in account_state.load_state(spark, str(tmp_path), wanted).collect()}
    assert got == {"x": (7.5, {"A": 1.0}), "y": (10_000.0, {})}


def test_order_log_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    plan = spark.createDataFrame(
        [("x", 1, DAY, "A", "BUY", 5.0, 0.6, "", True, "", ""), ("x", 2, DAY, "A", "BUY", 6.0, 0.6, "", True, "", ""), ("y", 1, DAY, "A", "BUY", 7.0, 0.6, "", False, "mode", "no")],
        "account string, seq long, signal_date date, symbol string, side string, amount double, score double, "
        "signal_reason string, risk_approved boolean, risk_rule string, risk_reason string",
    )
    records = order_log.order_records(plan)
    for _ in range(2):
        order_log.log_orders(records, path)
    got = order_log.read_order_records(spark, path).orderBy("account").collect()
    assert [(r["account"], r["order_id"], r["amount"], r["type"]) for r in got] == [
        ("x", "2024-05-10:A:BUY", 5.0, "approved"),
        ("y", "2024-05-10:A:BUY", 7.0, "rejected"),
    ]


def test_order_log_knows_plain_dated_files(spark, tmp_path):
    (tmp_path / "2024-05-10.jsonl").write_text(json.dumps({"order_id": "2024-05-10:A:BUY", "account": "x"}) + "\n")
    plan = spark.createDataFrame(
        [("x", i, DAY, s, "BUY", 5.0, 0.6, "", True, "", "") for i, s in enumerate("AB")],
        "account string, seq long, signal_date date, symbol string, side string, amount double, score double, "
        "signal_reason string, risk_approved boolean, risk_rule string, risk_reason string",
    )
    order_log.log_orders(order_log.order_records(plan), str(tmp_path))
    got = [r["order_id"] for r in order_log.read_order_records(spark, str(tmp_path)).collect()]
    assert sorted(got) == ["2024-05-10:A:BUY", "2024-05-10:B:BUY"]


PLAIN_FIELDS = [f.name for f in order_log.ORDER_LOG_SCHEMA.fields if f.name not in ("account", "seq")]


def test_order_log_takes_records_without_account_and_number(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("2024-05-10:B:BUY", "t2", "B", 5.0), ("2024-05-10:A:BUY", "t1", "A", 6.0), ("2024-05-10:A:BUY", "t3", "A", 7.0)]
    records = spark.createDataFrame(rows, "order_id string, timestamp string, symbol string, amount double").selectExpr(
        "order_id", "timestamp", "'2024-05-10' AS signal_date", "true AS dry_run", "'approved' AS type", "symbol", "'BUY' AS side", "amount",
        "0.6D AS score", "'why' AS signal_reason", "true AS risk_approved", "'' AS risk_rule", "'' AS risk_reason", "string(null) AS broker_status", "string(null) AS broker_order_id",
    )
    assert records.columns == PLAIN_FIELDS
    for _ in range(2):
        order_log.log_orders(records, path)
    got = order_log.read_order_records(spark, path).orderBy("order_id").collect()
    assert [(r["account"], r["seq"], r["order_id"], r["timestamp"], r["amount"], r["signal_reason"]) for r in got] == [
        ("default", None, "2024-05-10:A:BUY", "t1", 6.0, "why"),
        ("default", None, "2024-05-10:B:BUY", "t2", 5.0, "why"),
    ]


def test_orders_without_number_keep_the_order_of_the_file(spark, tmp_path):
    stamp = "2024-05-10T21:00:00+00:00"
    lines = [{"timestamp": stamp, "symbol": s, "side": "BUY", "amount": 1.0, "risk_approved": True} for s in "CABED"]
    lines.insert(2, {**lines[0], "symbol": "Z", "seq": 7})
    (tmp_path / "2024-05-10.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    got = order_log.load_orders(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["symbol"] for r in got] == ["Z", "C", "A", "B", "E", "D"] and len({r["seq"] for r in got}) == 6


def test_records_are_stamped_with_the_time_of_the_plan(spark):
    plan = spark.createDataFrame([("x", 1, DAY, "A", "BUY", 5.0, 0.6, "", True, "", "")], "account string, seq long, signal_date date, symbol string, side string, amount double, score double, signal_reason string, risk_approved boolean, risk_rule string, risk_reason string")
    now = dt.datetime.now(dt.timezone.utc)
    made = dt.datetime.fromisoformat(order_log.order_records(plan).first()["timestamp"])
    assert abs((made - now).total_seconds()) < 120
    assert order_log.order_records(plan, generated_at="2024-05-10T09:00:00+00:00").first()["timestamp"].startswith("2024-05-10T09")


def test_only_a_missing_path_is_an_empty_log(spark, tmp_path, monkeypatch):
    from pyspark.errors import AnalysisException

    assert order_log.read_order_records(spark, str(tmp_path / "none")) is None
    (tmp_path / "log").mkdir()
    monkeypatch.setattr(order_log, "ORDER_LOG_SCHEMA", T.StructType([*order_log.ORDER_LOG_SCHEMA.fields, order_log.ORDER_LOG_SCHEMA["symbol"]]))
    with pytest.raises(AnalysisException):
        order_log.read_order_records(spark, str(tmp_path / "log"))


def test_order_log_skips_bad_lines(spark, tmp_path):
    lines = [
        json.dumps({"timestamp": "2024-05-10T23:30:00-05:00", "symbol": "A", "side": "BUY", "risk_approved": True}),
        "{not json",
        json.dumps({"timestamp": "2024-05-10T21:00:00+00:00", "symbol": "B", "side": "BUY", "amount": 5.0}),
        json.dumps({"timestamp": "2024-05-10T21:00:00+00:00", "symbol": "C", "side": "SELL", "amount": 5.0, "score": 0.5, "risk_approved": True}),
    ]
    (tmp_path / "2024-05-10.jsonl").write_text("\n".join(lines) + "\n")
    got = sorted((r["symbol"], r["date"].day, r["amount"], r["score"]) for r in order_log.load_orders(spark, str(tmp_path)).collect())
    assert got == [("A", 11, 0.0, None), ("C", 10, 5.0, 0.5)]
    assert order_log.load_orders(spark, str(tmp_path / "nothing")).count() == 0


# --- replay ----------------------------------------------------------------


def _loop_replay(orders, closes, days, capital):
    """Day by day, order by order: the meaning of the replay."""
    cash, shares, curve = capital, {}, {}
    for day in days:
        for _, symbol, side, amount in sorted(o[1:] for o in orders if o[0] == day):
            price = closes.get((symbol, day))
            if price is None or price <= 0:
                continue
            if side == "BUY" and amount <= cash:
                shares[symbol] = shares.get(symbol, 0.0) + amount / price
                cash -= amount
            elif side == "SELL" and shares.get(symbol, 0.0) > 0:
                cash += shares.pop(symbol) * price
        worth = sum(n * max(closes.get((s, day)) or 0.0, 0.0) for s, n in shares.items())
        curve[day] = (cash, cash + worth)
    return curve


def test_replay_equals_plain_loop(spark, make_bars):
    rng = random.Random(5)
    days = business_days(40)
    closes = {s: [None if rng.random() < 0.1 else v for v in walk(40, i)] for i, s in enumerate("ABC")}
    closes["A"][0] = 100.0
    bars = make_bars(closes, days)
    price = {(s, d): v for s, vs in closes.items() for d, v in zip(days, vs)}
    books, rows = {}, []
    for account in range(12):
        rich = account % 2 == 0
        mine = []
        for seq in range(40):
            day = days[0] + dt.timedelta(days=rng.randrange(58))
            mine.append((day, seq, rng.choice("ABCX"), rng.choice(["BUY", "BUY", "SELL"]), float(rng.randrange(50, 400))))
        books[f"a{account}"] = (mine, 50_000.0 if rich else 700.0)
        rows += [(f"a{account}", *o) for o in mine]
    books["idle"] = ([], 123.0)
    orders = spark.createDataFrame(rows, "account string, date date, seq long, symbol string, side string, amount double")
    accounts = spark.createDataFrame([(a, c) for a, (_, c) in books.items()], "account string, capital double")
    known_days = sorted({d for (s, d), v in price.items() if v is not None})
    history = replay.build_equity_curve(orders, bars, accounts)
    got = {(r["account"], r["date"]): (r["cash"], r["value"]) for r in history.equity_curve.collect()}
    assert len(got) == len(books) * len(known_days)
    for account, (mine, capital) in books.items():
        for day, wanted in _loop_replay(mine, price, known_days, capital).items():
            assert got[account, day] == pytest.approx(wanted)
    refused = replay.executed_orders(orders, bars, accounts).filter("side = 'BUY' and not executed").select("account").distinct()
    assert 0 < refused.count() < len(books)


def test_only_orders_from_the_first_refusal_on_are_taken_one_by_one(spark, make_bars):
    days = business_days(30)
    bars = make_bars({"A": walk(30, 1)}, days)
    rows = [("late", d, 1, "A", "BUY", 10.0) for d in days[:25]] + [("late", days[25], 1, "A", "BUY", 5000.0), ("late", days[26], 1, "A", "SELL", 0.0)]
    rows += [("rich", d, 1, "A", "BUY", 10.0) for d in days]
    orders = spark.createDataFrame(rows, "account string, date date, seq long, symbol string, side string, amount double")
    accounts = spark.createDataFrame([("late", 1000.0), ("rich", 1000.0)], "account string, capital double")
    filled = replay._all_filled(replay._priced(orders, bars).join(accounts, "account"))
    exact, rest = (x.collect() for x in replay.split_at_first_refusal(filled))
    assert len(exact) == 55 and [(r["account"], r["side"], r["capital"]) for r in sorted(rest, key=lambda r: r["date"])] == [("late", "BUY", 750.0), ("late", "SELL", 750.0)]
    last = replay.executed_orders(orders, bars, accounts).filter("account = 'late' AND side = 'SELL'").first()
    shares = sum(10.0 / v for v in walk(30, 1)[:25])
    assert last["executed"] and last["cash_after"] == pytest.approx(750.0 + shares * walk(30, 1)[26])


def test_late_refusals_send_no_row_through_python(spark, make_bars, monkeypatch):
    """An account with a late refusal, or a big one with a few, is replayed by sums alone."""

    def refuse(rest):
        raise AssertionError("rows would be replayed one by one")

    monkeypatch.setattr(replay, "_one_by_one", refuse)
    monkeypatch.setattr(replay, "FOLD_ROWS", 0)
    days = business_days(60)
    bars = make_bars({"A": walk(60, 1), "B": walk(60, 2)}, days)
    mine = [(d, 1, "A", "BUY", 10.0) for d in days[:25]] + [(d, 2, "B", "BUY", 5000.0) for d in days[25:40]]
    mine += [(d, 3, "B", "BUY", 7.0) for d in days[20:40]] + [(days[41], 1, "A", "SELL", 0.0), (days[41], 2, "B", "SELL", 0.0)]
    mine += [(days[50], 1, "B", "SELL", 0.0), (days[51], 1, "A", "BUY", 2000.0), (days[52], 1, "A", "BUY", 400.0)]
    orders = spark.createDataFrame([("late", *o) for o in mine], "account string, date date, seq long, symbol string, side string, amount double")
    accounts = spark.createDataFrame([("late", 1000.0)], "account string, capital double")
    assert replay.executed_orders(orders.filter("date < '%s'" % days[41]), bars, accounts).count() == 60
    price = {(s, d): v for s, i in (("A", 1), ("B", 2)) for d, v in zip(days, walk(60, i))}
    history = replay.build_equity_curve(orders, bars, accounts)
    got = {r["date"]: (r["cash"], r["value"]) for r in history.equity_curve.collect()}
    wanted = _loop_replay(mine, price, days, 1000.0)
    assert got.keys() == wanted.keys()
    for day in days:
        assert got[day] == pytest.approx(wanted[day])


@pytest.mark.parametrize("rounds", [0, 3])
def test_replay_does_not_depend_on_its_rounds(spark, make_bars, rounds):
    rng = random.Random(9)
    days = business_days(50)
    closes = {s: walk(50, i) for i, s in enumerate("ABC")}
    bars = make_bars(closes, days)
    price = {(s, d): v for s, vs in closes.items() for d, v in zip(days, vs)}
    books = {
        f"p{a}": sorted((rng.choice(days), n, rng.choice("ABC"), rng.choice(["BUY", "BUY", "SELL"]), float(rng.randrange(40, 300))) for n in range(60))
        for a in range(8)
    }
    books["whole"] = [(d, 1, "A", "BUY", 100.0) for d in days]  # spends its cash to the last cent, then is refused
    rows = [(a, *o) for a, mine in books.items() for o in mine]
    orders = spark.createDataFrame(rows, "account string, date date, seq long, symbol string, side string, amount double")
    accounts = spark.createDataFrame([(a, 700.0) for a in books], "account string, capital double")
    done = replay.executed_orders(orders, bars, accounts, rounds).collect()
    assert len(done) == len(rows)
    last = {}
    for r in sorted(done, key=lambda r: (r["date"], r["seq"])):
        last[r["account"], r["date"]] = r["cash_after"]
    for account, mine in books.items():
        wanted = _loop_replay(mine, price, days, 700.0)
        for (a, day), cash in last.items():
            if a == account:
                assert cash == pytest.approx(wanted[day][0], abs=1e-6)


def test_weekly_returns_end_on_friday(spark):
    days = [dt.date(2024, 1, 4), dt.date(2024, 1, 5), dt.date(2024, 1, 6), dt.date(2024, 1, 11), dt.date(2024, 1, 25)]
    eq = spark.createDataFrame([("x", d, v) for d, v in zip(days, [100.0, 110.0, 99.0, 121.0, 60.5])], "account string, date date, value double")
    got = [(r["week_end"].day, round(r["weekly_return"], 9)) for r in replay.weekly_returns(eq).orderBy("week_end").collect()]
    assert got == [(12, 0.1), (26, -0.5)]
    assert replay.weekly_returns(eq.limit(1)).count() == 0


def test_portfolio_stats(spark):
    days = business_days(5)
    eq = spark.createDataFrame([("x", d, v) for d, v in zip(days, [100.0, 110.0, 99.0, 120.0, 130.0])], "account string, date date, value double")
    bench = spark.createDataFrame([(d, v) for d, v in zip(days[1:], [10.0, 11.0, 12.0, 9.0])], "date date, close double")
    row = replay.compute_portfolio_stats(eq, bench).first()
    assert (row["start_date"], row["end_date"], row["n_days"]) == (days[1], days[4], (days[4] - days[1]).days)
    assert row["total_return"] == pytest.approx(130 / 110 - 1) and row["benchmark_total_return"] == pytest.approx(-0.1)
    assert row["excess_return"] == pytest.approx(row["cagr"] - row["benchmark_cagr"])
    assert replay.compute_portfolio_stats(eq, bench.limit(1)).count() == 0


# --- rebalancing -----------------------------------------------------------


def _loop_simulation(scores, closes, days, top_n, min_score, bps):
    """Day by day: rebalance on the first day of an ISO week, then apply the day's return."""
    symbols = sorted({s for s, _ in closes})
    value, held, curve, trades, known, last = 1.0, set(), {}, [], {}, {}
    seen_week = None
    for day in days:
        week = day.isocalendar()[:2]
        if week != seen_week:
            seen_week = week
            if known:
                ranked = sorted((-p, s) for s, p in known.items() if p >= min_score)[:top_n]
                new = {s for _, s in ranked}
                if held or new:
                    names = held | new
                    old_w = {s: 1 / len(held) for s in held}
                    new_w = {s: 1 / len(new) for s in new}
                    moved = sum(abs(new_w.get(s, 0) - old_w.get(s, 0)) for s in names)
                    cash = abs(sum(old_w.values()) - sum(new_w.values()))
                    value = max(0.0, value - (moved + cash) / 2 * value * bps * 1e-4)
                trades += [(day, s, "buy", known[s]) for s in new - held] + [(day, s, "sell", known[s]) for s in held - new]
                held = new
        gain = 0.0
        for s in symbols:
            price = closes.get((s, day))
            if price is not None:
                if s in held and s in last:
                    gain += (price / last[s] - 1) / len(held)
                last[s] = price
        value *= 1 + gain
        curve[day] = value
        known.update({s: p for (s, d), p in scores.items() if d == day and p is not None})
    return curve, sorted(trades)


@pytest.mark.parametrize("seed,top_n,bps", [(1, 1, 0.0), (2, 2, 5.0), (3, 3, 200.0)])
def test_simulation_equals_plain_loop(spark, make_bars, seed, top_n, bps):
    rng = random.Random(seed)
    days = business_days(70)
    closes = {s: [None if rng.random() < 0.08 else v for v in walk(70, seed * 10 + i)] for i, s in enumerate("ABCD")}
    bars = make_bars(closes, days)
    price = {(s, d): v for s, vs in closes.items() for d, v in zip(days, vs) if v is not None}
    scores = {(s, d): round(rng.uniform(0.4, 0.7), 2) for s, d in price if d > days[12] and rng.random() < 0.6}
    frame = spark.createDataFrame([(s, d, p) for (s, d), p in scores.items()], "symbol string, date date, proba_up double")
    result = rebalance.simulate(frame, bars, top_n=top_n, min_score=0.58, costs_bps=bps)
    curve, trades = _loop_simulation(scores, price, sorted({d for _, d in price}), top_n, 0.58, bps)
    got = {r["date"]: r["value"] for r in result.equity_curve.collect()}
    assert got == pytest.approx(curve)
    assert sorted((r["date"], r["symbol"], r["action"], r["score"]) for r in result.trades_log.collect()) == trades


def test_simulation_of_intraday_bars_holds_its_sets(spark, make_bars):
    """Four bars a day, of which three repeat the close: the days' last values are those of daily bars."""
    rng = random.Random(4)
    days = business_days(40)
    closes = {s: walk(40, 30 + i) for i, s in enumerate("ABCD")}
    bars = make_bars(closes, days)
    rows = [(s, d, round(rng.uniform(0.4, 0.7), 2)) for s in "ABCD" for d in days[5:] if rng.random() < 0.6]
    scores = spark.createDataFrame(rows, "symbol string, date date, proba_up double")
    hours = F.explode(F.array(*[F.expr(f"INTERVAL {h} HOURS") for h in (9, 11, 13, 15)]))
    timed = bars.withColumn("_h", hours).withColumn("date", F.col("date").cast("timestamp_ntz") + F.col("_h")).drop("_h")
    late = scores.withColumn("date", F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 15 HOURS"))
    daily = rebalance.simulate(scores, bars, top_n=2, costs_bps=20.0)
    intraday = rebalance.simulate(late, timed, top_n=2, costs_bps=20.0)
    wanted = {r["date"]: r["value"] for r in daily.equity_curve.collect()}
    got = {r["date"].date(): r["value"] for r in intraday.equity_curve.filter("hour(date) = 15").collect()}
    assert got == pytest.approx(wanted) and len(got) == 40
    logged = lambda r: sorted((str(x["date"])[:10], x["symbol"], x["action"], x["score"]) for x in r.trades_log.collect())
    assert logged(daily) == logged(intraday) != []
    filled = rebalance.daily_score_matrix(scores, bars).filter("score is not null").count()
    assert filled > 0
    matrix = rebalance.daily_score_matrix(late, timed).filter("hour(date) = 9 and score is not null")
    assert matrix.count() == filled


def test_only_weekly_rebalancing(spark, make_bars):
    with pytest.raises(ValueError):
        rebalance.simulate(None, None, rebalance_frequency="daily")


def test_scenarios_side_by_side(spark, make_bars):
    days = business_days(30)
    bars = make_bars({"A": walk(30, 1), "B": walk(30, 2)}, days)
    rows = [(n, s, d, p) for n, p in (("one", 0.6), ("two", 0.3)) for s in "AB" for d in days]
    frame = spark.createDataFrame(rows, "scenario string, symbol string, date date, proba_up double")
    curve = rebalance.simulate(frame, bars).equity_curve.groupBy("scenario").agg(F.count("*").alias("n"), F.countDistinct("value").alias("v"))
    got = {r["scenario"]: (r["n"], r["v"]) for r in curve.collect()}
    assert got["one"][0] == got["two"][0] == 30 and got["two"][1] == 1 and got["one"][1] > 20
