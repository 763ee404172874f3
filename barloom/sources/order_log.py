"""Order log: JSON lines, one folder per signal date, written without duplicates."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.exprs import utc_date
from barloom.session import kept
from barloom.sources.files import is_missing

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()

# The 15 logged fields; ``account`` and ``seq`` are added for books
# of several accounts and for a stable order within a day.
ORDER_LOG_SCHEMA = T.StructType(
    [
        T.StructField("order_id", _S),
        T.StructField("timestamp", _S),
        T.StructField("signal_date", _S),
        T.StructField("dry_run", _B),
        T.StructField("type", _S),
        T.StructField("symbol", _S),
        T.StructField("side", _S),
        T.StructField("amount", _D),
        T.StructField("score", _D),
        T.StructField("signal_reason", _S),
        T.StructField("risk_approved", _B),
        T.StructField("risk_rule", _S),
        T.StructField("risk_reason", _S),
        T.StructField("broker_status", _S),
        T.StructField("broker_order_id", _S),
        T.StructField("account", _S),
        T.StructField("seq", T.LongType()),
    ]
)
DEFAULT_ACCOUNT = "default"
#: Where a record stands in the log: its file, the part of the file, the line.
PLACE = ["_file", "_block", "_line"]


def order_records(plan: DataFrame, dry_run: bool = True, generated_at: str | Column | None = None) -> DataFrame:
    """Log records of a plan ``(account, seq, signal_date, symbol, side, ...)``.

    ``generated_at`` is the time the plan was made; without it, the time of this call.
    """
    if generated_at is None:
        generated_at = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    stamp = F.lit(generated_at) if isinstance(generated_at, str) else generated_at
    day = F.date_format("signal_date", "yyyy-MM-dd")
    return plan.select(
        F.concat_ws(":", day, "symbol", "side").alias("order_id"),
        stamp.alias("timestamp"),
        day.alias("signal_date"),
        F.lit(dry_run).alias("dry_run"),
        F.when(F.col("risk_approved"), "approved").otherwise("rejected").alias("type"),
        "symbol",
        "side",
        "amount",
        "score",
        "signal_reason",
        "risk_approved",
        "risk_rule",
        "risk_reason",
        F.lit(None).cast("string").alias("broker_status"),
        F.lit(None).cast("string").alias("broker_order_id"),
        "account",
        "seq",
    )


def named(records: DataFrame) -> DataFrame:
    """Records with all fields of the log; those without an account belong to the default one."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in ORDER_LOG_SCHEMA.fields if f.name not in records.columns}
    return records.withColumns(missing).withColumn("account", F.coalesce("account", F.lit(DEFAULT_ACCOUNT)))


def first_per_order_id(records: DataFrame) -> DataFrame:
    """Keep the first record of each account and order id.

    First is the one with the smallest ``seq``, then time, then values; records
    without ``seq`` come after those that have one. A partial aggregate: repeats
    are dropped before the shuffle, however often one id was sent.
    """
    cols = records.columns
    rest = [c for c in ("amount", "score", "risk_approved", "signal_reason", "risk_rule", "risk_reason") if c in cols]
    order = F.struct(F.isnull("seq").alias("unnumbered"), "seq", "timestamp", *rest)
    first = records.groupBy("account", "order_id").agg(F.min_by(F.struct(*cols), order).alias("_first"))
    return first.select("_first.*")


def new_records(records: DataFrame, logged: DataFrame | None) -> DataFrame:
    """Records whose id is neither logged already nor repeated in the batch."""
    fresh = first_per_order_id(named(records))
    if logged is None:
        return fresh
    known = named(logged).select("account", "order_id")
    return fresh.join(known, ["account", "order_id"], "left_anti").select(fresh.columns)


def read_order_records(spark: SparkSession, path: str) -> DataFrame | None:
    """Every readable log record, or None when nothing has been logged."""
    placed = _read(spark, path)
    return None if placed is None else placed.drop(*PLACE)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """Records with their place; only a path that does not exist means an empty log."""
    schema = T.StructType([*ORDER_LOG_SCHEMA.fields, T.StructField("_corrupt_record", _S)])
    try:
        raw = (
            spark.read.schema(schema)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("recursiveFileLookup", True)
            .json(path)
        )
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return None
    return named(
        raw.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        )
    )


def log_orders(records: DataFrame, path: str) -> None:
    """Append the records not logged yet, one folder per signal date.

    Logging the same plan again adds nothing. Known ids are looked up only in
    the folders and files named by the batch's own dates, and no others are
    listed, so the cost of a run does not grow with the log. The batch is
    evaluated once.
    """
    batch = kept(named(records), "orders")
    dates = sorted(r["signal_date"] for r in batch.select("signal_date").distinct().collect() if r["signal_date"])
    logged = _read(batch.sparkSession, f"{path.rstrip('/')}/*{{{','.join(dates)}}}*") if dates else None
    (
        new_records(batch, logged)
        .withColumn("file_date", F.col("signal_date"))
        .repartition("file_date", "account")
        .sortWithinPartitions("file_date", "account", "seq", "timestamp", "order_id")
        .write.mode("append")
        .partitionBy("file_date")
        .json(path)
    )


def numbered(records: DataFrame) -> DataFrame:
    """Give records without ``seq`` the numbers after those of their account and day.

    They keep the order of the log: file, then line. An account logs one order
    per symbol and side and day, which bounds the window.
    """
    day = Window.partitionBy("account", "date")
    order = day.orderBy(F.col("seq").asc_nulls_last(), "timestamp", *PLACE)
    after = F.coalesce(F.max("seq").over(day), F.lit(0)) + F.row_number().over(order)
    return records.withColumn("seq", F.coalesce("seq", after.cast("long")))


def approved_orders(records: DataFrame) -> DataFrame:
    """``(account, date, seq, symbol, side, amount, score)`` of the approved records.

    A missing approval counts as no, a missing amount as 0. Records without
    time, symbol or side are bad lines and are skipped.
    """
    return records.filter(
        F.coalesce("risk_approved", F.lit(False))
        & F.col("timestamp").isNotNull()
        & F.col("symbol").isNotNull()
        & F.col("side").isNotNull()
    ).select(
        "account",
        utc_date(F.col("timestamp")).alias("date"),
        *(c for c in ("seq", "timestamp", *PLACE) if c in records.columns),
        "symbol",
        "side",
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        "score",
    )


def load_orders(spark: SparkSession, path: str) -> DataFrame:
    """Approved orders of a log folder, numbered within account and day; empty when there is none."""
    records = _read(spark, path)
    if records is None:
        return approved_orders(spark.createDataFrame([], ORDER_LOG_SCHEMA)).drop("timestamp")
    good = records.filter("_corrupt_record is null").drop("_corrupt_record")
    return numbered(approved_orders(good)).drop("timestamp", *PLACE)
