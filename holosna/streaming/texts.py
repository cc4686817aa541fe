"""Streams of texts. Every expression and kernel here is stateless: a stream takes what a batch takes, in append mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def started(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Writes step(stream) to parquet, each row once. once: all that is there, then it ends; else a batch every interval."""
    writer = step(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start(path)


def counted(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows a window of time and value of ``by``; rows later than ``late`` are left out by a stream, and its state stays bounded."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
