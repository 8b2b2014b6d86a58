"""Windows and guards over event streams, with late rows bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, at: str, late: str, length: str, keys: Sequence[str], measures: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Measures by tumbling or sliding window and key."""
    out = events.withWatermark(at, late).groupBy(F.window(at, length, slide or length), *keys).agg(*measures)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(events: DataFrame, at: str, late: str, gap: str, keys: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """Measures by session: rows of a key with no gap as long as ``gap`` between them. A stream needs a key."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(*measures)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def first_seen(events: DataFrame, at: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Events without those whose keys came before within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
