"""Progress of jobs as a stream: typed events, the last status of each file, counters by time.

The functions take batch and streaming DataFrames alike. Where a stream's state would grow without
end, a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The events of a job, its phases, and the statuses of a file.
EVENT_TYPES = ("phase", "file", "segment_progress", "estimate", "review_requested", "log", "finished", "progress")
PHASES = ("preparing", "extracting", "translating", "reviewing", "injecting", "finished")
FILE_STATUSES = ("pending", "processing", "success", "cached", "partial", "ignore", "error")


def progress(events: DataFrame, window: str, late: str | None = None, time: str = "ts") -> DataFrame:
    """Rows (hour, event_type, n, last_event): events by window and type. late: how long a window of a stream stays open."""
    if late:  # a watermark takes a time with a zone
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = events.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "last_event")


def last_status(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """Rows (key, event_type, ts): the last event of each key, of those at the same time the one with
    the largest event_id; in update mode on a stream."""
    last = F.max_by("event_type", F.struct(time, "event_id"))
    return events.groupBy(key).agg(last.alias("event_type"), F.max(time).alias(time))


def written_as_lines(events: DataFrame, path: str, checkpoint: str):
    """Start a query that appends the events of a stream to a folder of JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
