"""Inputs derived from the star-schema test tables.

There are no price files, so bars are rolled up from orders: the order priority
is the symbol, the order total gives the price. Hourly bars come from events.
Accounts are nations, subscribed to the symbols their customers order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.history import over_history
from barloom.operators.orders import RiskConfig, build_execution_plan, signals_to_proposed_orders
from barloom.operators.ranking import enrich_with_context, rule_score
from barloom.operators.replay import PortfolioHistory, build_equity_curve
from barloom.operators.signals import generate_signals, signal_sequence, top_rows
from barloom.operators.splits import WalkForwardSplit
from barloom.session import kept
from barloom.sources.bars import bars_from_ticks

# Parameters of the registered queries.
SPLITTER = WalkForwardSplit(n_splits=5, min_train_size=252, test_size=63, gap=1)
TOP_N, MIN_SCORE, MIN_SCORE_DOWN = 2, 0.50, 0.60
RISK = RiskConfig(
    max_positions=3,
    cash_buffer_pct=0.65,
    approved_universe=("1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, one symbol per order priority."""
    return bars_from_ticks(
        table(spark, sf_dir, "orders"),
        symbol=F.col("o_orderpriority"),
        time=F.to_date("o_orderdate"),
        price=100 + F.col("o_totalprice") / 250000,
        sequence=F.col("o_orderkey"),
    )


def wide_bars(spark: SparkSession, sf_dir: str, buckets: int = 16) -> DataFrame:
    """Daily bars with many symbols: priority and a hash bucket of the customer."""
    bucket = F.pmod(F.xxhash64("o_custkey"), F.lit(buckets))
    return bars_from_ticks(
        table(spark, sf_dir, "orders"),
        symbol=F.concat_ws("-", "o_orderpriority", bucket.cast("string")),
        time=F.to_date("o_orderdate"),
        price=100 + F.col("o_totalprice") / 250000,
        sequence=F.col("o_orderkey"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars (the ``date`` column is a timestamp), one symbol per event type."""
    return bars_from_ticks(
        table(spark, sf_dir, "events"),
        symbol=F.col("event_type"),
        time=F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"),
        price=100 + F.col("value") / 250,
        sequence=F.col("ts"),
    )


def scores(panel: DataFrame) -> DataFrame:
    """``(symbol, date, proba_up)``: the rule score as a stand-in for a model."""
    return rule_score(panel).withColumnRenamed("score", "proba_up")


def as_of_dates(panel: DataFrame) -> DataFrame:
    """Last trading day of each month with the one after it: calendar-sized."""
    months = panel.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("as_of"))
    return over_history(
        months.withColumn("_axis", F.lit("all")),
        lambda w: {"next_as_of": F.lead("as_of").over(w)},
        keys=["_axis"],
        order="as_of",
        ahead=1,
    ).select("as_of", "next_as_of")


PLAN_KEYS = ["account", "signal_date"]


class Desk:
    """The monthly signal desk over one set of test tables.

    Every table is built when first asked for. Tables that several others read
    (bars, signals, plan) are written once to the shared folder.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def bars(self) -> DataFrame:
        return kept(bars(self.spark, self.sf_dir), "bars")

    @cached_property
    def scored(self) -> DataFrame:
        """``(as_of, next_as_of, symbol, score)`` at each month end."""
        by_day = rule_score(self.bars).withColumnRenamed("date", "as_of")
        return by_day.join(as_of_dates(self.bars), "as_of")

    @cached_property
    def ranking(self) -> DataFrame:
        """``(as_of, symbol, score, context...)``."""
        return kept(enrich_with_context(self.scored.drop("next_as_of"), self.bars), "ranking")

    @cached_property
    def held(self) -> DataFrame:
        """``(as_of, symbol)``: the best symbols of the month before."""
        best = top_rows(self.scored, TOP_N, ["as_of"]).filter("next_as_of is not null")
        return best.select(F.col("next_as_of").alias("as_of"), "symbol")

    @cached_property
    def signals(self) -> DataFrame:
        return kept(
            generate_signals(
                self.ranking, self.held, top_n=TOP_N, min_score=MIN_SCORE, min_score_downtrend=MIN_SCORE_DOWN
            ),
            "signals",
        )

    @cached_property
    def accounts(self) -> DataFrame:
        """``(account, balance, cash)``: one per nation, sized by its customers; the
        share of the balance held as cash differs by region."""
        people = (
            table(self.spark, self.sf_dir, "customer")
            .groupBy(F.col("c_nationkey").alias("n_nationkey"))
            .agg(F.count("*").alias("n"))
        )
        money = 5000.0 + 10.0 * F.col("n")
        share = F.lit(0.7) + F.lit(0.1) * F.col("n_regionkey")
        return (
            table(self.spark, self.sf_dir, "nation")
            .join(people, "n_nationkey")
            .select(F.col("n_name").alias("account"), money.alias("balance"), (money * share).alias("cash"))
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        """``(account, symbol)``: symbols ordered by the nation's customers."""
        who = table(self.spark, self.sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        pairs = (
            table(self.spark, self.sf_dir, "orders")
            .select("o_custkey", F.col("o_orderpriority").alias("symbol"))
            .join(who, "o_custkey")
            .select(F.col("c_nationkey").alias("n_nationkey"), "symbol")
            .distinct()
        )
        names = table(self.spark, self.sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("account"))
        return kept(pairs.join(names, "n_nationkey").select("account", "symbol"), "subscriptions")

    @cached_property
    def proposed(self) -> DataFrame:
        """Orders for each account's symbols, numbered in output order per account and date."""
        mine = self.signals.join(self.subscriptions, "symbol").withColumnRenamed("as_of", "signal_date")
        return signals_to_proposed_orders(signal_sequence(mine, PLAN_KEYS), self.accounts, RISK)

    @cached_property
    def plan(self) -> DataFrame:
        proposed = kept(self.proposed, "proposed")
        snapshot = proposed.select(*PLAN_KEYS).distinct().join(self.accounts, "account")
        held = (
            self.held.withColumnRenamed("as_of", "signal_date")
            .join(self.subscriptions, "symbol")
            .select(*PLAN_KEYS, "symbol")
        )
        return kept(build_execution_plan(proposed, snapshot, held, RISK, keys=PLAN_KEYS), "plan")

    @cached_property
    def history(self) -> PortfolioHistory:
        """Replay of the approved orders from half the balance, so that some BUYs are refused."""
        return build_equity_curve(*self.replay_inputs)

    @property
    def replay_inputs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        orders = self.plan.filter("risk_approved").withColumnRenamed("signal_date", "date")
        capital = self.accounts.select("account", (F.col("balance") / 2).alias("capital"))
        return orders, self.bars, capital

    @property
    def benchmark(self) -> DataFrame:
        """``(date, close)``: mean close of all symbols per day."""
        return self.bars.groupBy("date").agg(F.avg("close").alias("close"))
