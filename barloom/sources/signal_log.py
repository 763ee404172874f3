"""Signal log: CSV files named by date (plain files or one folder per date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.exprs import utc_date
from barloom.functions.numbering import numbered
from barloom.operators.forward_returns import NO_ACTION
from barloom.operators.ranking import CONTEXT_COLUMNS

# Column order of a signal file and the names that count as dated.
LOG_COLUMNS = ["date", "rank", "symbol", "score", "action", "reason", *CONTEXT_COLUMNS]
DATED_FILE = r"(?:^|/)(?:file_date=)?(\d{4}-\d{2}-\d{2})(?:\.csv)?(?:/part-[^/]*)?$"

#: Rows of a date that go into one file.
ROWS_PER_FILE = 100_000

_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LOG_COLUMNS])


def signal_log_rows(
    ranking: DataFrame, signals: DataFrame, keys: Sequence[str] = ("as_of",)
) -> DataFrame:
    """The rows of a signal file: ranking with 1-based rank, action and reason.

    Ranks are counted in two levels, so a universe is spread over many tasks.
    """
    on = [*keys, "symbol"]
    return (
        numbered(ranking, keys, [F.col("score").desc(), F.col("symbol")], "rank")
        .withColumn("rank", F.col("rank").cast("int"))
        .join(signals.select(*on, "action", "reason"), on, "left")
        .withColumns(
            {"action": F.coalesce("action", F.lit("")), "reason": F.coalesce("reason", F.lit(""))}
        )
        .withColumnsRenamed({"as_of": "date"})
        .select(LOG_COLUMNS)
    )


def write_signal_log(rows: DataFrame, path: str) -> None:
    """Write one folder per date; a date written again replaces its folder.

    A date's rows are cut into files of consecutive ranks, one task each.
    """
    flag = F.when(F.col("above_sma_200"), "True").when(~F.col("above_sma_200"), "False")
    (
        rows.withColumn("above_sma_200", flag)
        .withColumn("file_date", F.date_format("date", "yyyy-MM-dd"))
        .repartition("file_date", F.floor(F.col("rank") / ROWS_PER_FILE))
        .sortWithinPartitions("file_date", "rank")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("file_date")
        .csv(path)
    )


def _scan(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.schema(_TEXT_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    named = F.regexp_extract(F.col("_metadata.file_path"), DATED_FILE, 1)
    return raw.withColumn("file", F.nullif(named, F.lit("")))


def _typed(raw: DataFrame) -> DataFrame:
    flag = F.when(F.col("above_sma_200") == "True", True).when(F.col("above_sma_200") == "False", False)
    return raw.select(
        utc_date(F.col("date")).alias("date"),
        F.col("rank").try_cast("int").alias("rank"),
        "symbol",
        F.col("score").try_cast("double").alias("score"),
        F.coalesce(F.nullif("action", F.lit("")), F.lit(NO_ACTION)).alias("action"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        *[F.col(c).try_cast("double").alias(c) for c in CONTEXT_COLUMNS[:4]],
        flag.alias("above_sma_200"),
        "file",
    )


def read_signal_log(spark: SparkSession, path: str) -> DataFrame:
    """All signal files below ``path``: mixed date forms to UTC days, bad scores to NULL.

    ``file`` is the date in a file's name, NULL for other names; a row's own
    ``date`` counts, not its file. Analysis output lies in a folder of its own.
    """
    return _typed(_scan(spark, path))


def latest_file_date(spark: SparkSession, path: str) -> str | None:
    """Newest dated name below ``path``; only file names are listed, nothing is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.regexp_extract("path", DATED_FILE, 1).alias("d"))
        .filter("d <> ''")
    )
    return files.agg(F.max("d").alias("d")).first()["d"]


def read_latest_signals(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest dated file; undated names never count.

    Refuses a file that mixes several dates: it is a merged export.
    """
    newest = latest_file_date(spark, path)
    if newest is None:
        raise ValueError(f"no dated signal file below {path}")
    rows = _typed(_scan(spark, path).filter(F.col("_metadata.file_path").contains(newest)))
    rows = rows.filter(F.col("file") == newest)
    if rows.agg(F.countDistinct("date").alias("n")).first()["n"] > 1:
        raise ValueError(f"signal file {newest} mixes several dates")
    return rows


def write_analysis(rows: DataFrame, path: str) -> None:
    """Write signals with forward returns to a folder of their own.

    Kept apart from the log so that a later scan of the log never reads it.
    """
    rows.write.mode("overwrite").option("header", True).csv(path)
