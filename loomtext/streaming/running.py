"""Metrics over streams of events: running counters in update mode, and windows with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def running_counts(events: DataFrame, group: str = "event_type") -> DataFrame:
    """(group, n, errors, total, slowest) so far; the state is one row for each group."""
    return events.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("total"), F.max("value").alias("slowest"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours", time: str = "ts") -> DataFrame:
    """(start, event_type, n, mean): tumbling windows; rows later than `late` behind the newest are left out.

    With late=None no row is late and no window is ever closed: the state is one row for each window and type.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped if late is None else stamped.withWatermark(time, late)
    grouped = stamped.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def run_to_end(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream over all that is there; a second run with the same checkpoint goes on where the first ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
