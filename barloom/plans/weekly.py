"""The weekly desk routine over stored tables: signals, orders, log, state, analysis.

Each step reads what the step before wrote, so steps can run as separate jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.forward_returns import add_forward_returns, signal_summaries
from barloom.operators.models import CalibratedLogisticRegression, Model
from barloom.operators.orders import (
    RiskConfig,
    account_snapshot,
    apply_orders,
    build_execution_plan,
    signals_to_proposed_orders,
)
from barloom.operators.quality import executable_actions
from barloom.operators.ranking import enrich_with_context, rank_universe
from barloom.operators.rebalance import SimulationResult, simulate
from barloom.operators.replay import build_equity_curve, compute_portfolio_stats
from barloom.operators.signals import generate_signals
from barloom.operators.splits import Splitter, WalkForwardSplit
from barloom.operators.walkforward import run_walk_forward_proba
from barloom.session import kept
from barloom.sources.account_state import load_state, save_state
from barloom.sources.bars import slice_dates
from barloom.sources.order_log import load_orders, log_orders, order_records
from barloom.sources.signal_log import read_latest_signals, read_signal_log, signal_log_rows, write_signal_log


@dataclass(frozen=True)
class DeskSettings:
    """Model, folds and limits of the weekly run."""

    model: Model = CalibratedLogisticRegression()
    splitter: Splitter = WalkForwardSplit(n_splits=5, min_train_size=252, test_size=63, gap=1)
    target: str = "direction"
    top_n: int = 5
    min_score: float = 0.55
    min_score_downtrend: float = 0.62
    risk: RiskConfig = RiskConfig()


def write_weekly_signals(
    bars: DataFrame, held: DataFrame, as_of: str, log_path: str, settings: DeskSettings = DeskSettings()
) -> DataFrame:
    """Rank the universe up to ``as_of``, decide the signals and add them to the log.

    ``held`` is ``(symbol)``. Returns the ranking with its context.
    """
    panel = slice_dates(bars, end=as_of)
    day = F.lit(as_of).cast("date").alias("as_of")
    scored = rank_universe(panel, settings.model, settings.splitter, settings.target)
    # the fits are done once; log and signals both read the result
    ranking = kept(enrich_with_context(scored, panel).select(day, "*"), "ranking")
    signals = generate_signals(
        ranking,
        held.select(day, "symbol"),
        top_n=settings.top_n,
        min_score=settings.min_score,
        min_score_downtrend=settings.min_score_downtrend,
    )
    write_signal_log(signal_log_rows(ranking, signals), log_path)
    return ranking


def propose_and_log_orders(
    spark: SparkSession,
    signal_path: str,
    state_path: str,
    new_state_path: str,
    order_path: str,
    subscriptions: DataFrame,
    settings: DeskSettings = DeskSettings(),
    dry_run: bool = True,
    generated_at: str | None = None,
) -> DataFrame:
    """Turn the newest signals into risk-checked orders of every account.

    ``subscriptions`` is ``(account, symbol)``: what each account trades. Orders keep the rank order of the file. The plan is logged without
    duplicates, stamped with ``generated_at`` or the time of the run, and the
    state after the approved orders goes to a new folder.
    """
    actions = executable_actions(read_latest_signals(spark, signal_path)).select(
        F.col("date").alias("signal_date"),
        "symbol",
        "action",
        "score",
        "reason",
        F.col("rank").cast("long").alias("seq"),
    )
    state = load_state(spark, state_path, subscriptions)
    followed = subscriptions.select("account", "symbol").distinct().join(actions, "symbol")
    snapshot = account_snapshot(state)
    proposed = signals_to_proposed_orders(followed, snapshot, settings.risk)
    positions = snapshot.select("account", F.explode("open_positions").alias("symbol"))
    plan = kept(build_execution_plan(proposed, snapshot, positions, settings.risk), "plan")
    log_orders(order_records(plan, dry_run, generated_at), order_path)
    save_state(apply_orders(state, plan.filter("risk_approved")), new_state_path)
    return plan


def analyse_signal_log(spark: SparkSession, signal_path: str, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All past signals with forward returns, and their three summaries."""
    enriched = kept(add_forward_returns(read_signal_log(spark, signal_path), bars), "analysis")
    return enriched, signal_summaries(enriched)


def order_log_report(
    spark: SparkSession, order_path: str, bars: DataFrame, benchmark: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Replay the order log of every account and compare it with the benchmark."""
    history = build_equity_curve(load_orders(spark, order_path), bars, accounts)
    return compute_portfolio_stats(history.equity_curve, benchmark)


def simulated_report(
    bars: DataFrame, benchmark: DataFrame, settings: DeskSettings = DeskSettings(), costs_bps: float = 5.0
) -> tuple[SimulationResult, DataFrame]:
    """Weekly rebalancing on model scores, with its stats against the benchmark."""
    scores = kept(
        run_walk_forward_proba(bars, settings.model, settings.splitter, settings.target).drop("fold", "close"), "scores"
    )
    result = simulate(
        scores, bars, top_n=settings.top_n, min_score=settings.min_score, costs_bps=costs_bps
    )
    return result, compute_portfolio_stats(result.equity_curve, benchmark, keys=["scenario"])
