"""Orders from signals, risk rules, execution plans and account state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.fold import ordered_fold

DEFAULT_CASH = 10_000.0


@dataclass(frozen=True)
class RiskConfig:
    """Limits of the demo account. An empty universe allows every symbol."""

    mode: str = "demo"
    max_positions: int = 5
    max_position_pct: float = 0.20
    max_trade_amount_pct: float = 0.20
    cash_buffer_pct: float = 0.05
    approved_universe: tuple[str, ...] = ()


def signals_to_proposed_orders(signals: DataFrame, accounts: DataFrame, config: RiskConfig) -> DataFrame:
    """Buys become sized BUY orders, sells full SELL orders; the rest is dropped.

    ``signals`` carry ``account`` and a ``seq`` that fixes their order;
    ``accounts`` give the balance.
    """
    amount = F.round(F.lit(config.max_trade_amount_pct) * F.col("balance"), 2)
    buys = F.col("action") == "buy"
    return (
        signals.filter(F.col("action").isin("buy", "sell"))
        .join(accounts.select("account", "balance"), "account")
        .withColumns(
            {
                "side": F.when(buys, "BUY").otherwise("SELL"),
                "amount": F.when(buys, amount).otherwise(F.lit(0.0)),
                "signal_reason": F.coalesce("reason", F.lit("")),
                "leverage": F.lit(1),
            }
        )
        .drop("action", "reason", "balance")
    )


def risk_result(config: RiskConfig) -> Column:
    """``struct(approved, rule, reason)`` of an order row: the first broken rule wins.

    Reads the columns ``side, symbol, amount, leverage, balance, cash, n_open``
    (open positions before the order) and ``is_open`` (symbol among them).
    """
    side, symbol, amount = F.col("side"), F.col("symbol"), F.col("amount")
    balance, cash = F.col("balance"), F.col("cash")
    limit = F.lit(config.max_trade_amount_pct) * balance
    floor = F.lit(config.cash_buffer_pct) * balance
    buying = side == "BUY"

    def said(text: str, *args: Column) -> Column:
        return F.format_string(text, *args) if args else F.lit(text)

    # Rule names, their order and the wording of the reasons.
    rules = [
        (
            "mode",
            F.lit(config.mode != "demo"),
            said(
                f"Account mode is '{config.mode}'.  Only 'demo' mode is supported.  "
                "Real trading is not permitted through this system."
            ),
        ),
        (
            "leverage",
            F.col("leverage") != 1,
            said("Leverage %dx is not allowed.  Only leverage=1 (no leverage) is permitted.", F.col("leverage")),
        ),
        (
            "short_sell",
            (side == "SELL") & ~F.col("is_open"),
            said(
                "Cannot SELL %s: symbol is not in current positions.  Short selling is not permitted.", symbol
            ),
        ),
        (
            "max_positions",
            buying & (F.col("n_open") >= config.max_positions),
            said(
                f"Cannot open new position in %s: already holding %d / {config.max_positions} maximum positions.",
                symbol,
                F.col("n_open"),
            ),
        ),
        (
            "max_trade_size",
            (balance > 0) & (amount > limit),
            said(
                f"Order amount %.2f exceeds {config.max_trade_amount_pct * 100:.0f}%% of account balance (%.2f).",
                amount,
                limit,
            ),
        ),
        (
            "cash_buffer",
            buying & (cash - amount < floor),
            said(
                "Insufficient cash: buying %.2f would leave %.2f which is below the required "
                f"{config.cash_buffer_pct * 100:.0f}%% buffer (%.2f).",
                amount,
                cash - amount,
                floor,
            ),
        ),
        (
            "universe",
            _outside_universe(config),
            said("%s is not in the approved trading universe.", symbol),
        ),
    ]
    rule, reason = F.lit(""), F.lit("")
    for name, broken, text in reversed(rules):
        rule = F.when(broken, name).otherwise(rule)
        reason = F.when(broken, text).otherwise(reason)
    return F.struct((rule == "").alias("approved"), rule.alias("rule"), reason.alias("reason"))


def _outside_universe(config: RiskConfig) -> Column:
    if not config.approved_universe:
        return F.lit(False)
    return ~F.col("symbol").isin(list(config.approved_universe))


def validate_orders(orders: DataFrame, config: RiskConfig) -> DataFrame:
    """Check each order on its own against the account columns it carries."""
    return orders.withColumn("_risk", risk_result(config)).select(
        *orders.columns,
        F.col("_risk.approved").alias("risk_approved"),
        F.col("_risk.rule").alias("risk_rule"),
        F.col("_risk.reason").alias("risk_reason"),
    )


def build_execution_plan(
    proposed: DataFrame,
    accounts: DataFrame,
    positions: DataFrame,
    config: RiskConfig,
    keys: Sequence[str] = ("account",),
) -> DataFrame:
    """Check orders in ``seq`` order; an approved one changes cash and positions for the next.

    ``accounts`` is ``(keys, balance, cash)`` and ``positions`` the open
    ``(keys, symbol)``. Each decision depends on the ones before it, so the
    orders of one plan are streamed in order through a fold whose state is the
    cash and the open set; rules, texts and everything else stay columns.
    """
    on = list(keys)
    limit = F.lit(config.max_trade_amount_pct) * F.col("balance")
    static_ok = (
        F.lit(config.mode == "demo")
        & (F.col("leverage") == 1)
        & ~((F.col("balance") > 0) & (F.col("amount") > limit))
        & ~_outside_universe(config)
    )
    opening = positions.select(*on, "symbol").distinct().withColumn("side", F.lit("OPEN"))
    events = (
        proposed.unionByName(opening, allowMissingColumns=True)
        .join(accounts.select(*on, "balance", F.col("cash").alias("_start")), on)
        .withColumn("_passes", F.coalesce(static_ok, F.lit(False)))
        .withColumn("_floor", F.lit(config.cash_buffer_pct) * F.col("balance"))
        .withColumn("_turn", F.when(F.col("side") == "OPEN", F.lit(-1)).otherwise(F.col("seq")).cast("long"))
    )
    most = config.max_positions

    def new_state():
        held: set[str] = set()
        cash: list[float] = []

        def step(symbol, side, amount, passes, start, floor):
            if not cash:
                cash.append(start)
            seen = (cash[0], len(held), symbol in held)
            if side == "OPEN":
                held.add(symbol)
            elif side == "BUY" and passes and len(held) < most and cash[0] - amount >= floor:
                cash[0] -= amount
                held.add(symbol)
            elif side == "SELL" and passes:
                held.discard(symbol)
            return (*seen, cash[0])

        return step

    decided = ordered_fold(
        events,
        on,
        ["_turn"],
        ["symbol", "side", "amount", "_passes", "_start", "_floor"],
        [
            T.StructField("cash", T.DoubleType()),
            T.StructField("n_open", T.LongType()),
            T.StructField("is_open", T.BooleanType()),
            T.StructField("cash_after", T.DoubleType()),
        ],
        new_state,
    )
    orders = decided.filter("side <> 'OPEN'").drop("_start", "_passes", "_floor", "_turn")
    return validate_orders(orders, config).drop("is_open").withColumnsRenamed(
        {"cash": "cash_before", "n_open": "open_before"}
    )


def plan_summary(plan: DataFrame, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Cash before and after each plan with the approved and rejected counts."""
    return plan.groupBy(*keys).agg(
        F.min_by("cash_before", "seq").alias("cash_before"),
        F.max_by("cash_after", "seq").alias("cash_after_est"),
        F.count_if("risk_approved").alias("n_approved"),
        F.count_if(~F.col("risk_approved")).alias("n_rejected"),
    )


def apply_orders(state: DataFrame, approved: DataFrame) -> DataFrame:
    """New account state after approved orders ``(account, seq, signal_date, symbol, side, amount)``.

    A BUY marks the symbol as held and lowers the cash; a SELL removes it and
    leaves the cash, because the fill price is unknown. Cash never goes below 0.
    Only the last order per account and symbol decides, so orders are
    pre-aggregated per symbol and never gathered per account.
    """
    last = approved.groupBy("account", "symbol").agg(
        F.max_by("side", "seq").alias("side"),
        F.sum(F.when(F.col("side") == "BUY", F.col("amount")).otherwise(F.lit(0.0))).alias("spent"),
        F.max("signal_date").alias("signal_date"),
    )
    owned = state.select("account", F.explode(F.map_keys("positions")).alias("symbol"), F.lit(True).alias("_old"))
    after = (
        owned.join(last, ["account", "symbol"], "full_outer")
        .filter(F.coalesce(F.col("side") == "BUY", F.col("_old"), F.lit(False)))
        .groupBy("account")
        .agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct(F.col("symbol"), F.lit(1.0).alias("held"))))
            ).alias("_positions")
        )
    )
    spent = last.groupBy("account").agg(
        F.sum("spent").alias("_spent"), F.max("signal_date").alias("_date")
    )
    empty = F.create_map().cast("map<string,double>")
    return (
        state.join(spent, "account", "left")
        .join(after, "account", "left")
        .select(
            "account",
            F.greatest(F.lit(0.0), F.col("cash") - F.coalesce("_spent", F.lit(0.0))).alias("cash"),
            F.coalesce("_positions", empty).alias("positions"),
            F.coalesce("_date", "last_signal_date").alias("last_signal_date"),
            F.coalesce("_date", "last_rebalance_date").alias("last_rebalance_date"),
        )
    )


def account_snapshot(state: DataFrame) -> DataFrame:
    """Balance (= cash), cash and open symbols of each account."""
    return state.select(
        "account",
        F.col("cash").alias("balance"),
        "cash",
        F.sort_array(F.map_keys("positions")).alias("open_positions"),
    )
