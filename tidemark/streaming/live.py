"""Streaming forms: grouped counts by window, and sessions by pause, with watermarks. The batch operators stay the exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys; rows later than `late` are dropped, and state with them. events: ts, keys."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("actor").alias("actors")).select(F.col("window.start").alias("start"), *keys, "n", "actors")


def sessions(events: DataFrame, pause: str, late: str, key: str = "actor") -> DataFrame:
    """Sessions of a key ended by a pause. A pause of exactly that length ends one here; sequences.gap_sessions keeps it together."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", pause), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
