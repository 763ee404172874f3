"""Time the headline workloads and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each workload starts from the raw tables and is forced in full by a no-op write.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from barloom.operators import experiments, models  # noqa: E402
from barloom.operators.backtest import run_backtest  # noqa: E402
from barloom.operators.forward_returns import add_forward_returns, signal_summaries  # noqa: E402
from barloom.operators.metrics import return_summary  # noqa: E402
from barloom.operators.ranking import enrich_with_context, rank_universe, rule_score  # noqa: E402
from barloom.operators.rebalance import simulate  # noqa: E402
from barloom.operators.signals import generate_signals  # noqa: E402
from barloom.operators.targets import make_dataset  # noqa: E402
from barloom.operators.walkforward import run_walk_forward, run_walk_forward_proba  # noqa: E402
from barloom.plans import inputs  # noqa: E402
from barloom.session import kept, local_session  # noqa: E402
from barloom.sources.signal_log import signal_log_rows  # noqa: E402


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.wide_bars(spark, sf)


def features_targets(spark: SparkSession, sf: str) -> DataFrame:
    return make_dataset(inputs.wide_bars(spark, sf))


def rule_backtest(spark: SparkSession, sf: str) -> DataFrame:
    predictions = run_walk_forward(inputs.wide_bars(spark, sf), models.PreviousDirection(), inputs.SPLITTER)
    return return_summary(run_backtest(predictions, costs_bps=5.0), {"": ("strategy_return", "position")})


def calibrated_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    panel = inputs.wide_bars(spark, sf)
    return run_walk_forward_proba(panel, models.CalibratedLogisticRegression(), inputs.SPLITTER)


def weekly_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated ranking of the whole universe, context, signals and log rows."""
    panel = kept(inputs.wide_bars(spark, sf), "bars")
    ranking = kept(
        enrich_with_context(rank_universe(panel, models.CalibratedLogisticRegression(), inputs.SPLITTER), panel)
        .selectExpr("date'2001-08-01' AS as_of", "*"),
        "ranking",
    )
    held = ranking.filter("score < 0.52").select("as_of", "symbol")
    return signal_log_rows(ranking, generate_signals(ranking, held, top_n=10, min_score=0.5))


def simulation(spark: SparkSession, sf: str) -> DataFrame:
    panel = kept(inputs.wide_bars(spark, sf), "bars")
    scores = rule_score(panel).withColumnRenamed("score", "proba_up")
    return simulate(scores, panel, top_n=10, min_score=0.55).equity_curve


def signal_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Forward returns and summaries when every symbol is signalled every day."""
    panel = kept(inputs.wide_bars(spark, sf), "bars")
    signals = rule_score(panel).selectExpr(
        "*", "CASE WHEN score >= 0.55 THEN 'buy' ELSE '' END AS action", "score > 0.5 AS above_sma_200"
    )
    return signal_summaries(add_forward_returns(signals, panel))


def order_replay(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.Desk(spark, sf).history.equity_curve


def experiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    periods = [{"period": "all", "start": "1995-01-01", "end": "2001-12-31"}]
    rules = {"AlwaysLong": models.AlwaysLong(), "PreviousDirection": models.PreviousDirection()}
    return experiments.run_grid(inputs.wide_bars(spark, sf), periods, rules)


def learned_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with a model fitted to every history."""
    periods = [{"period": "all", "start": "1995-01-01", "end": "2001-12-31"}]
    learned = {"AlwaysLong": models.AlwaysLong(), "CalibratedLR": models.CalibratedLogisticRegression()}
    return experiments.run_grid(inputs.wide_bars(spark, sf), periods, learned)


def pooled_forest(spark: SparkSession, sf: str) -> DataFrame:
    """200 trees over all symbols, one distributed fit per fold."""
    return run_walk_forward_proba(inputs.wide_bars(spark, sf), models.RandomForest(), inputs.SPLITTER)


WORKLOADS = [
    bars,
    features_targets,
    rule_backtest,
    calibrated_walk_forward,
    weekly_signal,
    simulation,
    signal_analysis,
    order_replay,
    experiment_grid,
    learned_grid,
    pooled_forest,
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g")
    spark.sparkContext.setLogLevel("ERROR")
    features_targets(spark, sf).write.format("noop").mode("overwrite").save()  # warm up the JVM
    took = {}
    for work in WORKLOADS:
        start = time.perf_counter()
        work(spark, sf).write.format("noop").mode("overwrite").save()
        took[work.__name__] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
