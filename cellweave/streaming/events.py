"""Streams: windowed counts of events, elapsed times, and a file queue whose files are worked off exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, key, n, total) of tumbling or sliding windows of event time; rows later than the watermark are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): runs of events of one key with no pause longer than ``gap``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def work_off(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every new batch to ``work`` once and stop when nothing is left; the checkpoint remembers what is done."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
