"""Structured Streaming: windows, sessions and de-duplication over event streams, and change feeds.

Each function takes a streaming or a static DataFrame: with a static one it gives the batch twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    x = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return x.withWatermark(ts, late) if events.isStreaming else x


def windows(events: DataFrame, size: str, slide: str | None = None, ts: str = "ts", late: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, end, by, n, total) of tumbling windows, or of sliding ones with ``slide``; rows later than ``late`` are dropped by a stream."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    x = _timed(events, ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, ts: str = "ts", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """(by, start, end, n): runs of events without a pause of ``gap``."""
    x = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return x.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, *keys: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once; a stream forgets keys after ``late``."""
    x = _timed(events, ts, late)
    return x.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else x.dropDuplicates(list(keys))


def feed(changes: DataFrame, apply: Callable[[DataFrame], object], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies a stream of document changes batch by batch; the checkpoint folder makes it resume where it ended."""
    w = changes.writeStream.foreachBatch(lambda df, _: apply(df)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
