"""Account-state table: cash, held symbols and the dates of the last signal and rebalance."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.orders import DEFAULT_CASH
from barloom.sources.files import is_missing

STATE_SCHEMA = T.StructType(
    [
        T.StructField("account", T.StringType()),
        T.StructField("cash", T.DoubleType()),
        T.StructField("positions", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("last_signal_date", T.DateType()),
        T.StructField("last_rebalance_date", T.DateType()),
    ]
)


def with_defaults(accounts: DataFrame, saved: DataFrame | None) -> DataFrame:
    """State of each wanted account; one without (readable) state starts fresh."""
    none = F.lit(None)
    if saved is None:
        saved = accounts.sparkSession.createDataFrame([], STATE_SCHEMA)
    known = accounts.select("account").distinct().join(saved, "account", "left")
    return known.select(
        "account",
        F.coalesce("cash", F.lit(DEFAULT_CASH)).alias("cash"),
        F.coalesce("positions", F.create_map().cast("map<string,double>")).alias("positions"),
        F.coalesce("last_signal_date", none.cast("date")).alias("last_signal_date"),
        F.coalesce("last_rebalance_date", none.cast("date")).alias("last_rebalance_date"),
    )


def load_state(spark: SparkSession, path: str, accounts: DataFrame) -> DataFrame:
    """Read the JSON state table; a missing table or a corrupt line gives defaults."""
    try:
        saved = spark.read.schema(STATE_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        saved = None
    return with_defaults(accounts, saved)


def save_state(state: DataFrame, path: str) -> None:
    """Write the state table as JSON lines to a new or replaced folder.

    Must not be the folder ``state`` was lazily read from.
    """
    state.write.mode("overwrite").json(path)
