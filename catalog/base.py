"""Registration of queries with their output columns and check SQL.

The output of a query is described once, as ``name:kind`` words; the same words
shape the DataFrame and the SQL, so names, types and rounding agree. Kinds: a
digit rounds a double, ``i`` int, ``l`` bigint, ``t`` text, ``d`` date,
``b`` boolean, ``n`` timestamp.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

_SPARK_TYPES = {"i": "int", "l": "bigint", "t": "string", "d": "date", "b": "boolean", "n": "timestamp_ntz"}
_SQL_TYPES = {"i": "INTEGER", "l": "BIGINT", "t": "VARCHAR", "d": "DATE", "b": "BOOLEAN", "n": "TIMESTAMP"}


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(word.split(":")) for word in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        col = F.col(name)
        if kind.isdigit():
            out.append(F.round(col.cast("double"), int(kind)).alias(name))
        else:
            out.append(col.cast(_SPARK_TYPES[kind]).alias(name))
    return df.select(*out)


def shape_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind.isdigit():
            # adding 0 turns a negative zero into zero
            out.append(f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0 AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body})"


def query(name: str, spec: str, run: QueryFn, sql: str | None = None) -> None:
    """Register a query; ``sql`` may use the named tables of :data:`TABLES`."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(run(spark, sf_dir), spec)

    full = with_tables(shape_sql(sql, spec)) if sql is not None else None
    QUERIES[name] = Query(shaped, full)


# --- shared SQL ------------------------------------------------------------

TABLES: dict[str, str] = {}


def sql_table(name: str, body: str) -> None:
    TABLES[name] = body


def with_tables(body: str) -> str:
    """Prefix the common table expressions that ``body`` needs, in definition order."""
    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(TABLES[name])
    if not needed:
        return body
    def part(n: str) -> str:
        # a table used inside a recursion is computed once, not once per round
        kept = "" if re.search(rf"\b{n}\b", TABLES[n]) else "MATERIALIZED "
        return f"{n} AS {kept}({TABLES[n]})"

    parts = ", ".join(part(n) for n in TABLES if n in needed)
    return f"WITH RECURSIVE {parts} {body}"


def full(agg: str, col: str, n: int, part: str = "symbol", order: str = "date") -> str:
    """SQL of an aggregate over a complete trailing window."""
    w = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {agg}({col}) {w} END"


def features_sql(src: str, part: str = "symbol", extra: str = "") -> str:
    """SQL of the eleven features over ``src``."""
    w = f"OVER (PARTITION BY {part} ORDER BY date)"
    return f"""
    SELECT {part}, date, close{extra}, r AS return_1d, ln(close / c1) AS log_return_1d,
      c1 / c2 - 1 AS return_lag1, c2 / c3 - 1 AS return_lag2, c3 / c4 - 1 AS return_lag3,
      {full('avg', 'close', 10, part)} AS rolling_mean_10,
      {full('stddev_samp', 'r', 10, part)} AS rolling_vol_10,
      {full('avg', 'close', 5, part)} / ({full('avg', 'close', 20, part)}) AS sma_ratio_5_20,
      100 - 100 / (1 + ({full('avg', 'gain', 14, part)}) / nullif({full('avg', 'loss', 14, part)}, 0)) AS rsi_14,
      ({full('stddev_samp', 'r', 5, part)}) / ({full('stddev_samp', 'r', 20, part)}) AS vol_ratio_5_20,
      (close - ({full('avg', 'close', 20, part)})) / ({full('avg', 'close', 20, part)}) AS price_vs_mean_20
    FROM (
      SELECT *, close / c1 - 1 AS r,
        CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0) END AS gain,
        CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0) END AS loss
      FROM (SELECT *, lag(close, 1) {w} AS c1, lag(close, 2) {w} AS c2, lag(close, 3) {w} AS c3,
              lag(close, 4) {w} AS c4 FROM {src}))"""


def complete(cols: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def backtest_sql(predictions: str, keys: str = "symbol", costs: float = 0.0, hold: str = "1", choices=(1,), on: str = "symbol") -> str:
    """SQL of the backtest; ``hold`` is a number or a column with values in ``choices``."""
    w = f"PARTITION BY {keys} ORDER BY date"
    held = " ".join(
        f"WHEN {n} THEN least(max(sig) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), "
        f"CASE WHEN max(sig) OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) IS NOT NULL THEN 1.0 END)"
        for n in choices
    )
    extra = "" if hold.isdigit() or hold in keys else f", {hold}"
    return f"""
    SELECT *, product(1 + strategy_return) OVER ({w} ROWS UNBOUNDED PRECEDING) AS cumulative,
      product(1 + asset_return) OVER ({w} ROWS UNBOUNDED PRECEDING) AS buy_and_hold
    FROM (
      SELECT {keys}, date, close, asset_return, prediction, position,
        position * asset_return
          - coalesce(abs(position - lag(position) OVER ({w})), 0) * {costs} / 10000 AS strategy_return
      FROM (
        SELECT *, CASE {hold} {held} END AS position FROM (
          SELECT {keys}{extra}, date, close, close / lag(close) OVER ({w}) - 1 AS asset_return, prediction,
            CAST(lag(prediction) OVER ({w}) AS DOUBLE) AS sig
          FROM {predictions} p JOIN (SELECT symbol AS {on}, date, close FROM bars) b USING ({on}, date))))
    WHERE position IS NOT NULL AND asset_return IS NOT NULL"""


def summary_sql(src: str, ret: str, keys: str = "symbol", pos: str | None = None, prefix: str = "", rf: float = 0.0) -> str:
    """SQL of the return metrics of one column."""
    w = f"PARTITION BY {keys} ORDER BY date"
    ex = f"({ret} - {rf} / 252)"
    turn = f", avg(turned) AS {prefix}turnover" if pos else ""
    moved = f", abs({pos} - lag({pos}) OVER ({w})) AS turned" if pos else ""
    return f"""
    SELECT {keys}, product(1 + {ret}) - 1 AS {prefix}total_return,
      power(product(1 + {ret}), 252.0 / count(*)) - 1 AS {prefix}cagr,
      stddev_samp({ret}) * sqrt(252) AS {prefix}volatility,
      CASE WHEN stddev_samp({ex}) >= 1e-14 THEN avg({ex}) / stddev_samp({ex}) * sqrt(252) END AS {prefix}sharpe,
      min((eq - pk) / pk) AS {prefix}max_drawdown,
      avg(CASE WHEN {ret} > 0 THEN 1.0 ELSE 0.0 END) AS {prefix}hit_rate{turn}
    FROM (SELECT *, max(eq) OVER ({w} ROWS UNBOUNDED PRECEDING) AS pk
          FROM (SELECT *, product(1 + {ret}) OVER ({w} ROWS UNBOUNDED PRECEDING) AS eq{moved} FROM {src}))
    GROUP BY {keys}"""


SYM = "PARTITION BY symbol ORDER BY date"

sql_table(
    "bars",
    """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(px, o_orderkey) AS open,
       max(px) AS high, min(px) AS low, arg_max(px, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
       FROM (SELECT *, 100 + o_totalprice / 250000 AS px FROM orders) GROUP BY 1, 2""",
)
