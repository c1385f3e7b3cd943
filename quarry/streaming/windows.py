"""Event-time windows. The same function serves a stream (with a watermark) and a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, keys: list[str], aggregates: dict[str, Column], size: str, slide: str | None = None, late: str | None = None, session_gap: str | None = None) -> DataFrame:
    """Tumbling, sliding (slide) or session (session_gap) windows; rows later than ``late`` behind the stream are dropped."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    w = F.session_window(time, session_gap) if session_gap else F.window(time, size, slide)
    out = events.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)
