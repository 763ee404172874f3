from __future__ import annotations

import datetime as dt
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import local_session  # noqa: E402
from barloom.sources.bars import BAR_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def business_days(n: int, start: dt.date = dt.date(2020, 1, 1)) -> list[dt.date]:
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="session")
def make_bars(spark):
    """``make_bars({"AAA": [closes]})``: a bar panel with one row per business day."""

    def make(closes: dict[str, list[float | None]], days=None):
        rows = []
        for symbol, values in closes.items():
            for day, c in zip(days or business_days(len(values)), values):
                if c is not None:
                    rows.append((symbol, day, c, c + 1.0, c - 1.0, c, 100.0))
        return spark.createDataFrame(rows, BAR_SCHEMA)

    return make


def walk(n: int, seed: int, start: float = 100.0) -> list[float]:
    rng, out = random.Random(seed), [start]
    while len(out) < n:
        out.append(out[-1] * (1 + rng.gauss(0.0005, 0.01)))
    return out


def column(df, name: str, by: str = "date") -> list:
    return [r[name] for r in df.orderBy(by).collect()]
