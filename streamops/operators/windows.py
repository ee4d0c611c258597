"""Counts per key in tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamops.constants import WINDOW_SIZE


def agg_tumbling_count(
    df: DataFrame,
    key: str = "page",
    ts: str = "at",
    size: str = WINDOW_SIZE,
    delay: str | None = None,
) -> DataFrame:
    """Columns key, ``window_start``, ``window_end``, ``views``.

    ``delay`` sets the event-time watermark a streaming input needs. Counts are
    combined before the one shuffle on (key, window), so a hot key sends one row
    per task and window.
    """
    source = df if delay is None else df.withWatermark(ts, delay)
    return (
        source.groupBy(F.col(key), F.window(ts, size).alias("w"))
        .agg(F.count("*").alias("views"))
        .select(
            key,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "views",
        )
    )
