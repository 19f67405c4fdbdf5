"""Incremental increments as streams: generations by batch, exact dedup, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_of_each(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows of a stream without those that repeat ``key`` within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """Rows of each window and ``by``; rows later than ``late`` are too late for their window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def generations(changed: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of a stream of changed rows to ``merge`` with its number; batches that ran are not run again."""
    return changed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
