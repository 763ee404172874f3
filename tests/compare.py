"""Compare registered queries with their check SQL in DuckDB.

Usage: python -m tests.compare [name part ...] [--sf DIR]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

DEFAULT_DIR = "/root/testdata/sf0.01"

# Spark type -> DuckDB type that the check SQL must give
SAME_TYPE = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def open_duckdb(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Readable differences between a DataFrame and the SQL result; empty when equal."""
    out = []
    res = con.execute(sql)
    sql_cols = {d[0]: str(d[1]) for d in res.description}
    cols = sorted(df.columns)
    if cols != sorted(sql_cols):
        return [f"columns {cols} vs {sorted(sql_cols)}"]
    for f in df.schema.fields:
        want = SAME_TYPE[f.dataType.simpleString()]
        if want != sql_cols[f.name]:
            out.append(f"type of {f.name}: {want} vs {sql_cols[f.name]}")
    order = list(sql_cols)
    theirs = sorted((tuple(r[order.index(c)] for c in cols) for r in res.fetchall()), key=_key)
    ours = sorted((tuple(r) for r in df.select(*cols).collect()), key=_key)
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} vs {len(theirs)}")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, columns {cols}, first: {bad[0][0]} vs {bad[0][1]}")
    if any(isinstance(v, float) and math.isnan(v) for r in ours for v in r):
        out.append("NaN in result")
    return out


def main(argv: list[str]) -> int:
    from barloom.session import local_session

    import __spark_entry__ as entry

    sf_dir = DEFAULT_DIR
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if argv and not any(part in name for part in argv):
            continue
        t0 = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                diff = differences(df, con, sqls[name])
                rows = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
                if rows == 0:
                    diff.append("no rows")
            else:
                rows = df.count()
                diff = [] if rows else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            diff, rows = [f"{type(exc).__name__}: {str(exc)[:700]}"], -1
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok':4} {name:38} {rows:8} rows {time.time() - t0:6.1f}s", *diff, flush=True)
    print(f"{failed} failed")
    spark.stop()
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
