"""Replay an order log against closes into daily equity, and compare with a benchmark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.exprs import change, ratio
from barloom.functions.fold import ordered_fold
from barloom.functions.history import calendar_bounded, over_history, running
from barloom.operators.metrics import TRADING_DAYS, return_summary
from barloom.session import kept
from barloom.sources.bars import trading_days


# A running sum this close to zero may differ from the one-by-one replay; such
# a BUY is decided by the cash before it.
ROUNDING = 1e-6
#: How often the running sums start anew after a refused BUY, for every account and
#: while an account has more orders left than one task should replay in order.
ROUNDS, MOST_ROUNDS, FOLD_ROWS = 1, 20, 50_000


@dataclass(frozen=True)
class PortfolioHistory:
    """Daily tables per account: ``equity_curve`` (date, cash, value), ``cash`` and
    ``positions`` (date, symbol, shares; open positions only)."""

    equity_curve: DataFrame
    cash: DataFrame
    positions: DataFrame


def _priced(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """Orders that can execute: known side, trading day, symbol with a valid close."""
    closes = bars.select("symbol", "date", "close").filter("close > 0")
    return (
        orders.filter(F.col("side").isin("BUY", "SELL"))
        .select("account", "date", "seq", "symbol", "side", F.col("amount").cast("double").alias("amount"))
        .join(closes, ["symbol", "date"])
    )


def _all_filled(priced: DataFrame) -> DataFrame:
    """The replay when every BUY is filled that is not ``refused``, by running sums only.

    Per symbol, a SELL closes what was ``owned`` at the start or bought since the
    SELL before; per account, the cash is the start plus all flows. A log holds one
    order per account, day, symbol and side, so one account's orders in one symbol
    are few; the scan over a whole account is cut by day, so a big account is
    spread over its days. ``short`` marks a BUY that the cash would not cover, unless
    it is ``settled``: up to the first one the values are exact. ``gain`` is what all
    SELLs so far bring at most.
    """
    given = {"owned": F.lit(0.0), "refused": F.lit(False), "settled": F.lit(False)}
    priced = priced.withColumns({c: v for c, v in given.items() if c not in priced.columns})
    sell = F.col("side") == "SELL"
    paid = ~sell & ~F.col("refused")
    lots = priced.withColumns(
        {"_sold": sell.cast("long"), "_bought": F.when(paid, F.col("amount") / F.col("close")).otherwise(F.lit(0.0))}
    )
    mine = ["account", "symbol"]
    marked = running(lots, {"_round": ("sum", "_sold")}, keys=mine, order=["date", "seq"])
    # the SELL itself ends its round: it belongs to the shares before it
    marked = marked.withColumn("_round", F.col("_round") - F.col("_sold"))
    summed = running(marked, {"_shares": ("sum", "_bought")}, keys=[*mine, "_round"], order=["date", "seq"])
    summed = summed.withColumn("_shares", F.col("_shares") + F.when(F.col("_round") == 0, F.col("owned")).otherwise(0.0))
    proceeds = F.when(sell, F.col("_shares") * F.col("close")).otherwise(F.lit(0.0))
    flows = summed.withColumns({"_won": proceeds, "_flow": F.when(paid, -F.col("amount")).otherwise(proceeds)})
    totals = running(
        flows,
        {"_net": ("sum", "_flow"), "gain": ("sum", "_won")},
        keys=["account"],
        order=["date", "seq"],
        block="date" if calendar_bounded(flows) else None,
    )
    cash = F.col("capital") + F.col("_net")
    return totals.select(
        "account",
        "date",
        "seq",
        "symbol",
        "side",
        "amount",
        "close",
        "capital",
        cash.alias("cash_after"),
        F.when(sell, F.lit(0.0)).otherwise(F.col("_shares")).alias("shares_after"),
        F.when(sell, F.col("_shares") > 0).otherwise(~F.col("refused")).alias("executed"),
        (paid & ~F.col("settled") & (cash < ROUNDING)).alias("short"),
        "owned",
        "refused",
        "gain",
    )


def _one_by_one(priced: DataFrame) -> DataFrame:
    """The replay in order, from the first BUY that an account's cash does not cover.

    ``capital`` is the cash before that order, ``owned`` what the account then
    holds of the row's symbol.
    """

    def new_state():
        shares: dict[str, float] = {}
        cash: list[float] = []

        def step(symbol, side, amount, close, capital, at_first):
            if not cash:
                cash.append(capital)
            owned, done = shares.setdefault(symbol, at_first), False
            if side == "BUY" and amount <= cash[0]:
                shares[symbol] = owned + amount / close
                cash[0] -= amount
                done = True
            elif side == "SELL" and owned > 0:
                shares[symbol] = 0.0
                cash[0] += owned * close
                done = True
            return cash[0], shares[symbol], done

        return step

    fields = [
        T.StructField("cash_after", T.DoubleType()),
        T.StructField("shares_after", T.DoubleType()),
        T.StructField("executed", T.BooleanType()),
    ]
    return ordered_fold(
        priced, ["account"], ["date", "seq"], ["symbol", "side", "amount", "close", "capital", "owned"], fields, new_state
    ).select(
        "account", "date", "seq", "symbol", "side", "amount", "close", "cash_after", "shares_after", "executed"
    )


def split_at_first_refusal(filled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders whose running sums are exact, and those from an account's first short BUY on.

    The latter carry the cash before that BUY as ``capital`` and the shares then
    held of their symbol as ``owned``. That BUY is ``settled``: filled or ``refused``
    by this cash. Later BUYs are ``refused`` with it where they cost more than this
    cash and all that the SELLs in between bring if nothing is refused.
    """
    turn = F.struct("date", "seq")
    first = filled.filter("short").groupBy("account").agg(
        F.min(turn).alias("_cut"),
        F.min_by(F.col("cash_after") + F.col("amount"), turn).alias("_cash"),
        F.min_by("gain", turn).alias("_gain"),
    )
    marked = filled.join(first, "account", "left")
    exact = marked.filter(F.col("_cut").isNull() | (turn < F.col("_cut")))
    held = exact.filter("_cut IS NOT NULL").groupBy("account", "symbol").agg(F.max_by("shares_after", turn).alias("_held"))
    rest = marked.filter(turn >= F.col("_cut")).join(held, ["account", "symbol"], "left")
    ordered = ["account", "date", "seq", "symbol", "side", "amount", "close"]
    settled = turn == F.col("_cut")
    most = F.col("_cash") + F.when(settled, 0.0).otherwise(F.col("gain") - F.col("_gain") + ROUNDING)
    return (
        exact.select(*ordered, "cash_after", "shares_after", "executed"),
        rest.select(
            *ordered,
            F.col("_cash").alias("capital"),
            F.coalesce("_held", "owned").alias("owned"),
            (F.col("refused") | ((F.col("side") == "BUY") & (F.col("amount") > most))).alias("refused"),
            settled.alias("settled"),
        ),
    )


def executed_orders(orders: DataFrame, bars: DataFrame, accounts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Each executable order with ``executed`` and the cash and shares after it.

    Running sums do all orders up to an account's first refused BUY. From there
    the sums start anew, without the BUYs that are known to be refused, ``rounds``
    times; each round takes the accounts that are left one refusal on at least.
    More rounds follow, up to ``MOST_ROUNDS``, while some account has over
    ``FOLD_ROWS`` orders left. Only what then remains is taken one by one.
    """
    rest = _priced(orders, bars).join(accounts.select("account", "capital"), "account")
    done = None
    for turn in range(MOST_ROUNDS + 1):
        filled = kept(_all_filled(rest), "filled-orders")
        exact, rest = split_at_first_refusal(filled)
        done = exact if done is None else done.unionByName(exact)
        if filled.filter("short").isEmpty():
            return done
        if turn >= rounds and rest.groupBy("account").count().filter(F.col("count") > FOLD_ROWS).isEmpty():
            break
    return done.unionByName(_one_by_one(rest))


def build_equity_curve(orders: DataFrame, bars: DataFrame, accounts: DataFrame) -> PortfolioHistory:
    """Daily cash, positions and value of every account.

    ``orders`` is ``(account, date, seq, symbol, side, amount)``, ``accounts``
    ``(account, capital)``; an account without orders keeps its capital. A BUY
    spends ``amount`` at the close if the cash covers it, a SELL closes the
    position. State between orders is a run of trading days, exploded by day
    number: no range join. A position without a valid close on a day counts 0.
    """
    days = kept(trading_days(bars), "trading-days")
    last_day = days.select(F.max("day")).scalar()
    done = kept(executed_orders(orders, bars, accounts).filter("executed"), "executed-orders").join(days, "date")

    def runs(states: DataFrame, keys: list[str], value: str) -> DataFrame:
        nxt = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
        spans = states.withColumn("_end", F.coalesce(nxt - 1, last_day)).withColumn(
            "_from", F.greatest("day", F.lit(0).cast("long"))
        )
        return (
            spans.filter(F.col("_end") >= F.col("_from"))
            .select(*keys, value, F.explode(F.sequence("_from", "_end")).alias("day"))
            .join(days, "day")
            .select(*keys, "date", value)
        )

    order = F.struct("date", "seq")
    cash_states = done.groupBy("account", "day").agg(F.max_by("cash_after", order).alias("cash"))
    start = accounts.select("account", F.lit(-1).cast("long").alias("day"), F.col("capital").alias("cash"))
    cash = runs(cash_states.unionByName(start), ["account"], "cash")

    share_states = done.groupBy("account", "symbol", "day").agg(F.max_by("shares_after", order).alias("shares"))
    positions = runs(share_states, ["account", "symbol"], "shares").filter("shares > 0")

    closes = bars.select("symbol", "date", "close").filter("close > 0")
    worth = (
        positions.join(closes, ["symbol", "date"])
        .groupBy("account", "date")
        .agg(F.sum(F.col("shares") * F.col("close")).alias("worth"))
    )
    equity = cash.join(worth, ["account", "date"], "left").select(
        "account", "date", "cash", (F.col("cash") + F.coalesce("worth", F.lit(0.0))).alias("value")
    )
    return PortfolioHistory(equity, cash, positions)


def weekly_returns(equity: DataFrame, keys: Sequence[str] = ("account",), value: str = "value") -> DataFrame:
    """Return between the last values of consecutive weeks ending on Friday."""
    to_friday = F.pmod(F.lit(4) - F.weekday("date"), F.lit(7)).cast("int")
    weeks = equity.withColumn("week_end", F.date_add("date", to_friday)).groupBy(*keys, "week_end").agg(
        F.max_by(value, "date").alias("_value")
    )
    res = over_history(
        weeks,
        lambda w: {"weekly_return": change(F.col("_value"), F.lag("_value").over(w))},
        keys=keys,
        order="week_end",
        back=1,
    )
    return res.filter("weekly_return is not null").select(*keys, "week_end", "weekly_return")


# The compared metrics, in report order.
STAT_METRICS = ["total_return", "cagr", "volatility", "sharpe", "max_drawdown"]


def compute_portfolio_stats(
    equity: DataFrame,
    benchmark: DataFrame,
    *,
    keys: Sequence[str] = ("account",),
    value: str = "value",
    label: str = "portfolio",
    benchmark_label: str = "benchmark",
    risk_free: float = 0.0,
) -> DataFrame:
    """Strategy and benchmark metrics on their common dates, one row per account.

    ``benchmark`` is ``(date, close)``, one row per day. Groups with fewer than
    two common dates give no row.
    """
    common = equity.select(*keys, "date", F.col(value).alias("_eq")).join(
        benchmark.select("date", F.col("close").alias("_bm")), "date"
    )
    moved = over_history(
        common,
        lambda w: {
            "_re": change(F.col("_eq"), F.lag("_eq").over(w)),
            "_rb": change(F.col("_bm"), F.lag("_bm").over(w)),
            "_prev": F.lag("date").over(w),
        },
        keys=keys,
        back=1,
    )
    span = common.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("_n")
    )
    stats = return_summary(
        moved.filter("_prev is not null"), {"": ("_re", None), "benchmark_": ("_rb", None)}, keys, risk_free, TRADING_DAYS
    )
    return (
        span.filter("_n >= 2")
        .join(stats, list(keys))
        .select(
            *keys,
            F.lit(label).alias("label"),
            F.lit(benchmark_label).alias("benchmark_label"),
            "start_date",
            "end_date",
            F.date_diff("end_date", "start_date").alias("n_days"),
            *STAT_METRICS,
            *[f"benchmark_{m}" for m in STAT_METRICS],
            (F.col("cagr") - F.col("benchmark_cagr")).alias("excess_return"),
        )
    )


def positions_snapshot(history: PortfolioHistory) -> DataFrame:
    """Open positions, cash and value of each account on its last day."""
    last = history.equity_curve.groupBy("account").agg(
        F.max("date").alias("date"),
        F.max_by("cash", "date").alias("cash"),
        F.max_by("value", "date").alias("total"),
    )
    return last.join(history.positions, ["account", "date"], "left").select(
        "account", "date", "symbol", "shares", "cash", "total"
    )


def report_rows(stats: DataFrame, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Metric, strategy and benchmark as long rows."""
    lines = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(m).alias("strategy"), F.col(f"benchmark_{m}").alias("benchmark")
            )
            for m in STAT_METRICS
        ]
    )
    return stats.select(*keys, F.explode(lines).alias("line")).select(*keys, "line.*")


def normalised_curves(
    equity: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("account",), value: str = "value"
) -> DataFrame:
    """Strategy and benchmark on common dates, both divided by their first value."""
    common = equity.select(*keys, "date", F.col(value).alias("_eq")).join(
        benchmark.select("date", F.col("close").alias("_bm")), "date"
    )
    first = common.groupBy(*keys).agg(
        F.min_by("_eq", "date").alias("_e0"), F.min_by("_bm", "date").alias("_b0")
    )
    return common.join(first, list(keys)).select(
        *keys,
        "date",
        ratio(F.col("_eq"), F.col("_e0")).alias("strategy"),
        ratio(F.col("_bm"), F.col("_b0")).alias("benchmark"),
    )


def strategy_curves(backtests: DataFrame, keys: Sequence[str] = ("symbol",), strategy: str = "strategy") -> DataFrame:
    """Plot data: one cumulative curve per strategy plus buy-and-hold of the first.

    ``backtests`` holds several strategies told apart by the ``strategy``
    column; "first" is the alphabetically first. ``final_return`` labels a curve.
    """
    own = F.struct(F.col(strategy).alias("curve"), F.col("cumulative").alias("value"))
    market = F.struct(F.lit("buy_and_hold").alias("curve"), F.col("buy_and_hold").alias("value"))
    is_first = F.col(strategy) == F.min(strategy).over(Window.partitionBy(*keys))
    curves = backtests.withColumn("_first", is_first).select(
        *keys, "date", F.inline(F.array_compact(F.array(own, F.when(F.col("_first"), market))))
    )
    end = F.max_by("value", "date").over(Window.partitionBy(*keys, "curve"))
    return curves.withColumn("final_return", end - 1)
