"""Order records arriving as files, logged once each by a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from barloom.sources.order_log import ORDER_LOG_SCHEMA, log_orders


def stream_order_log(
    spark: SparkSession, incoming: str, log_path: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append new record files to the order log, skipping ids already logged.

    Takes what is there and stops. A batch repeated after a failure adds
    nothing, because each batch goes through the same duplicate check as a
    batch job; the shared ``checkpoint`` folder remembers the files done.
    """

    def append(batch, _batch_id: int) -> None:
        log_orders(batch, log_path)

    records = (
        spark.readStream.schema(ORDER_LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(incoming)
    )
    return (
        records.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
