"""Sessions of a stream and events that follow one another, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, delay: str, key: str = "user_id", at: str = "ts", value: str = "value") -> DataFrame:
    """(key, started, ended, n, total): runs of a key's events with less than ``gap`` between neighbours; ended is gap after the last.

    On a stream a session comes out once the watermark, ``delay`` behind the latest event,
    has reached its end, and its state goes; later events of it are dropped.
    """
    kept = events.withWatermark(at, delay) if events.isStreaming else events
    found = kept.groupBy(F.col(key), F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n", "total")


def followed(first: DataFrame, then: DataFrame, within: str, delay: str, key: str = "user_id", at: str = "ts", event: str = "event_id") -> DataFrame:
    """(key, first_id, then_id): events of ``then`` that come after one of ``first`` of the same key within a time.

    Both sides may be streams: watermarks and the bound on time let their states go.
    """
    a, b = (s.withWatermark(at, delay) if s.isStreaming else s for s in (first, then))
    x = a.select(F.col(key), F.col(event).alias("first_id"), F.col(at).alias("__first"))
    y = b.select(F.col(key).alias("__key"), F.col(event).alias("then_id"), F.col(at).alias("__then"))
    near = (F.col(key) == F.col("__key")) & (F.col("__then") > F.col("__first")) & (F.col("__then") <= F.col("__first") + F.expr(f"INTERVAL {within}"))
    return x.join(y, near).select(key, "first_id", "then_id")
