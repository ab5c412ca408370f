"""Cutting time into segments: declared phases, else weeks, days or hours by the span of the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import asof_backward

HOUR, DAY, WEEK = 3600, 86400, 604800
MONDAY = 4 * DAY  # 1970-01-05


def slice_of(t: Column, size: int) -> Column:
    """The start of t's week (from Monday), day or hour, in epoch seconds."""
    shift = MONDAY if size == WEEK else 0
    return (F.floor((t - shift) / size) * size + shift).cast("long")


def size_for(span: int) -> int:
    """Weeks beyond 60 days, days beyond three, else hours."""
    return WEEK if span > 60 * DAY else DAY if span > 3 * DAY else HOUR


def automatic(events: DataFrame) -> DataFrame:
    """segment_id, start_t of each slice that holds events; ids follow time."""
    low, high = events.agg(F.min("t"), F.max("t")).first()
    if low is None:
        return events.sparkSession.createDataFrame([], "segment_id long, start_t long")
    size = size_for(high - low)
    starts = events.select(slice_of(F.col("t"), size).alias("start_t")).distinct()
    first = (low - (MONDAY if size == WEEK else 0)) // size
    return starts.select((F.floor((F.col("start_t") - (MONDAY if size == WEEK else 0)) / size) - first).alias("segment_id"), "start_t")


def assign(events: DataFrame, segments: DataFrame) -> DataFrame:
    """events with segment_id: the last segment that starts at or before t; events before the first belong to it.

    Segments are phases or slices, a row each for the whole record, so one window of starts serves all events through a broadcast array.
    """
    starts = segments.agg(F.array_sort(F.collect_list(F.struct("start_t", "segment_id"))).alias("_s"))
    joined = events.crossJoin(F.broadcast(starts))
    at = F.filter("_s", lambda x: x["start_t"] <= F.col("t"))
    return joined.withColumn("segment_id", F.coalesce(F.get(at, F.size(at) - 1), F.get(F.col("_s"), F.lit(0)))["segment_id"]).drop("_s")


__all__ = ["assign", "asof_backward", "automatic", "size_for", "slice_of"]
