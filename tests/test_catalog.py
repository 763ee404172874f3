"""Every registered query against its check SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from catalog.base import QUERIES
from tests.compare import DEFAULT_DIR, differences, open_duckdb

SQL = entry.oracle_sql()
ROWS_ONLY = sorted(set(entry.queries()) - set(SQL))


@pytest.fixture(scope="module")
def con():
    return open_duckdb(DEFAULT_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, DEFAULT_DIR), con, SQL[name]) == []


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if n in QUERIES])
def test_learned_query_is_well_formed(spark, name):
    df = entry.queries()[name](spark, DEFAULT_DIR)
    share = next(c for c in ("proba_up", "score", "accuracy") if c in df.columns)
    rows = df.collect()
    assert rows and all(0.0 <= r[share] <= 1.0 for r in rows)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["c2_walk_forward_folds", "g4_threshold_sweep", "k1_probability_matrix", "k4_rebalance_ranking", "k7_equity_curve", "m1_equity_curve", "n2_forward_returns", "p2_best_per_group"])
def test_no_cross_or_range_join(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
