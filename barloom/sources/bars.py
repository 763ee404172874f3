"""Price-bar table: scan, normalise, slice, write, and roll-up from raw ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS]
)


def read_bars(
    spark: SparkSession,
    path: str,
    symbols: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    validate: bool = False,
) -> DataFrame:
    """Scan a bar table; symbols prune partitions, dates reach the Parquet reader.

    ``validate`` checks the slice that is read and raises on the first broken
    rule; ``operators.quality.sound_bars`` keeps the sound symbols instead.
    """
    bars = spark.read.schema(BAR_SCHEMA).parquet(path)
    if symbols is not None:
        bars = bars.filter(F.col("symbol").isin(symbols))
    bars = slice_dates(bars, start, end)
    if validate:
        from barloom.operators.quality import validate_bars

        bars = validate_bars(bars)
    return bars


def write_bars(bars: DataFrame, path: str) -> None:
    """Write one partition per symbol; only the symbols in ``bars`` are replaced.

    Rows are spread by symbol and year first, so a symbol with a long history
    is written by several tasks and no task opens a file for every symbol.
    """
    (
        bars.select(BAR_SCHEMA.fieldNames())
        .repartition("symbol", F.year("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("symbol")
        .parquet(path)
    )


def slice_dates(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with ``start <= date <= end``; either bound may be left out."""
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("date") <= F.lit(end).cast("date"))
    return bars


def normalise_bars(
    raw: DataFrame, *, time_col: str = "date", symbol: str | None = None, zone: str = "UTC"
) -> DataFrame:
    """Bring a raw download to the bar schema.

    Column names are lower-cased, a ``Price/Ticker`` style compound name keeps
    its first part, zone-less stamps are read as ``zone`` and moved to UTC, and
    only the seven bar columns survive.
    """
    lowered = raw.toDF(*[c.split("/")[0].strip().lower() for c in raw.columns])
    time_col = time_col.lower()
    kind = lowered.schema[time_col].dataType
    stamp = F.col(time_col)
    if isinstance(kind, T.TimestampNTZType):
        stamp = F.convert_timezone(F.lit(zone), F.lit("UTC"), stamp)
    elif isinstance(kind, T.TimestampType):
        stamp = F.to_utc_timestamp(stamp, F.current_timezone())
    name = F.lit(symbol) if symbol is not None else F.col("symbol")
    return lowered.select(
        name.cast("string").alias("symbol"),
        F.to_date(stamp).alias("date"),
        *[F.col(c).cast("double").alias(c) for c in PRICE_COLUMNS],
    )


def bars_from_ticks(
    ticks: DataFrame, *, symbol: Column, time: Column, price: Column, sequence: Column
) -> DataFrame:
    """Roll ticks up to bars; the first and last price follow ``sequence``.

    All five values are partial aggregates, so a symbol with most of the ticks
    is reduced on the map side before anything is shuffled.
    """
    named = ticks.select(
        symbol.alias("symbol"), time.alias("date"), price.alias("_px"), sequence.alias("_seq")
    )
    return named.groupBy("symbol", "date").agg(
        F.min_by("_px", "_seq").alias("open"),
        F.max("_px").alias("high"),
        F.min("_px").alias("low"),
        F.max_by("_px", "_seq").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def trading_days(bars: DataFrame) -> DataFrame:
    """Distinct dates with their 0-based ordinal ``day``: one row per calendar day at most."""
    from barloom.functions.history import position

    days = bars.select("date").distinct().withColumn("_axis", F.lit("all"))
    return position(days, keys=["_axis"], order="date", out="day").drop("_axis")
