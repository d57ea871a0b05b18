"""Structured Streaming front ends: event-time windows, and files processed once as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, time: str, key: str, value: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Start, key, n and sum of ``value`` per tumbling window; data later than ``late`` behind the newest are dropped.

    The state is one row per open window and key, closed by the watermark.
    """
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    agg = rows.groupBy(F.window("_t", width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.unix_seconds("w.start").alias("start"), "key", "n", "total")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is available into Parquet, exactly once across restarts, and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_updates(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is available through ``write(batch, epoch)`` in update mode; ``write`` must be idempotent."""
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """Rows of the Parquet files that arrive in ``folder``; files already processed are remembered by the checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def unprocessed(candidates: DataFrame, done: DataFrame, key: str = "file_id") -> DataFrame:
    """Batch form of the same rule: candidates whose key has no result yet."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")
