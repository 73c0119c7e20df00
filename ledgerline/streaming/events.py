"""Windows over order events, in batch or as a stream.

The functions take either kind of frame. On a stream, duplicates are dropped and
windows closed by the watermark; in batch, all rows are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "96 hours", ts: str = "ts") -> DataFrame:
    """``ts`` as a timestamp (a watermark takes no other kind), with a watermark."""
    df = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once; on a stream, within the watermark."""
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def _counted(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "96 hours") -> DataFrame:
    out = _counted(once(timed(events, late)).groupBy(F.window("ts", width), "event_type"))
    return out.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day") -> DataFrame:
    out = _counted(once(timed(events)).groupBy(F.window("ts", width, step), "event_type"))
    return out.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    out = _counted(once(timed(events)).groupBy(F.session_window("ts", gap), "user_id"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "value")


def matched(earlier: DataFrame, later: DataFrame, within: str = "1 hour") -> DataFrame:
    """(event_id, later_id, user_id): each event with those of another type by the
    same user in the time after it. On streams, both sides' watermarks and the range
    bound what is kept waiting."""
    a = earlier.select("event_id", F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    b = later.select(F.col("event_id").alias("later_id"), "user_id", "ts", "event_type")
    near = F.expr(f"user = user_id AND kind <> event_type AND ts > at AND ts <= at + INTERVAL {within}")
    return a.join(b, near).select("event_id", "later_id", "user_id")


def running(df: DataFrame, name: str, trigger: str = "available", sink: str = "memory", mode: str = "append", **options: str):
    """A started query. ``available`` takes what is there and ends; ``continuous`` (or
    ``continuous 5 seconds``, the time between its checkpoints) takes row by row, for
    projections and filters of sources that can; anything else is the time between
    micro-batches."""
    first, _, rest = trigger.partition(" ")
    how = {"availableNow": True} if first == "available" else {"continuous": rest or "1 second"} if first == "continuous" else {"processingTime": trigger}
    return df.writeStream.format(sink).queryName(name).outputMode(mode).options(**options).trigger(**how).start()
