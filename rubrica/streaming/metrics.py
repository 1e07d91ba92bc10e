"""Metrics over arriving scores, an extension: the batch metrics are sums, so they run under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark; batches stay as they are."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if df.isStreaming else df


def windowed_means(scores: DataFrame, time: str = "ts", value: str = "value", by: str = "metric", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, num, mean) of event-time windows; rows later than ``late`` are dropped by a stream."""
    g = _timed(scores, time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(value).alias("n"), F.sum(value).alias("num"))
    return g.select(F.col("w.start").alias("start"), by, "n", "num", F.try_divide("num", "n").alias("mean"))


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user, start, end, n) of runs of events with no gap as long as ``gap``."""
    g = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return g.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Starts a query that takes what has arrived, then stops; resumes from its checkpoint."""
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
