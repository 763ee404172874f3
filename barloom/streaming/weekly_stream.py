"""Weekly values of an equity table that arrives as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators import replay

DAY_SECONDS = 86_400


def weekly_values(
    equity: DataFrame, keys: Sequence[str] = ("account",), value: str = "value", late: str = "7 days"
) -> DataFrame:
    """Last value of each week ending on Friday, ``(*keys, date, value)``, of a stream.

    A week is given as soon as a row more than ``late`` after its end has arrived;
    rows of it that come later than that are left out. A row that is sent again
    changes nothing. State holds one row per key and open week.
    """
    at = F.timestamp_seconds(F.unix_date("date") * DAY_SECONDS)
    timed = equity.select(*keys, "date", F.col(value).alias("value"), at.alias("_time")).withWatermark("_time", late)
    # day 2 of the epoch was a Saturday
    week = F.window("_time", "7 days", startTime="2 days").alias("_week")
    closed = timed.groupBy(*keys, week).agg(F.max_by("value", "date").alias("value"))
    first = F.floor(F.unix_seconds("_week.start") / DAY_SECONDS).cast("int")
    return closed.select(*keys, F.date_from_unix_date(first + 6).alias("date"), "value")


def stream_weekly_values(equity: DataFrame, path: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Append the weeks that have closed to a Parquet folder, each once, and stop."""
    return (
        weekly_values(equity, late=late)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def streamed_weekly_returns(spark: SparkSession, path: str) -> DataFrame:
    """Weekly returns of the closed weeks: the batch operator over one row per account and week."""
    return replay.weekly_returns(spark.read.parquet(path))
