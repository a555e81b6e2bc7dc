"""An extension: files that arrive are imported once. The engine's batch import is a resumable job; this runs it per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notemill.operators.relational import pending


def follow(arriving: DataFrame, key: str, log: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """J3 on a stream: `work` gets each batch's rows whose key no earlier batch has written; its result goes to the log.

    The result holds the key. A batch has its own folder in the log, written over if the batch is run again, so a restart
    neither loses nor repeats rows. Checkpoint and log are on storage that driver and executors share.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if number:
            written = spark.read.schema(batch.select(key).schema.add("batch", "long")).parquet(log)
            fresh = pending(fresh, written.where(F.col("batch") < number), key)
        work(fresh).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
