"""Cutting the time-ordered record into chunks of bounded size, and its calendar."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(times: list[int], sizes: list[int], target: int, cap: int) -> list[tuple[int, int]]:
    """Index ranges of pieces: runs up to target; a piece over cap is cut at the largest pause in its middle half."""
    pieces, start, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > target:
            pieces.append((start, i))
            start, total = i, 0
        total += s
    if start < len(sizes):
        pieces.append((start, len(sizes)))
    out, todo = [], pieces[::-1]
    while todo:
        a, b = todo.pop()
        if b - a > 1 and sum(sizes[a:b]) > cap:
            low, high = a + max(1, (b - a) // 4), a + max(2, (3 * (b - a) + 3) // 4)
            m = max(range(low, min(high, b)), key=lambda k: (times[k] - times[k - 1], -k))
            todo += [(m, b), (a, m)]
        else:
            out.append((a, b))
    return out


def cut_chunks(events: DataFrame, target: int, cap: int) -> DataFrame:
    """day, chunk, start_t, end_t, events, chars, ids: every event is in exactly one chunk. Days are cut apart first; each is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"])
        t, s, ids = rows["t"].tolist(), rows["chars"].tolist(), rows["id"].tolist()
        out = [(int(rows["day"].iloc[0]), k, t[a], t[b - 1], b - a, sum(s[a:b]), ids[a:b]) for k, (a, b) in enumerate(split(t, s, target, cap))]
        return pd.DataFrame(out, columns=["day", "chunk", "start_t", "end_t", "events", "chars", "ids"])

    schema = "day long, chunk int, start_t long, end_t long, events int, chars long, ids array<long>"
    return events.select("id", "t", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), F.floor(F.col("t") / 86400).alias("day")).groupBy("day").applyInPandas(run, schema)


def calendar(events: DataFrame) -> DataFrame:
    """Per day: events, actors, new actors, and whether it is a spike, max(100, three times the median day)."""
    day = F.floor(F.col("t") / 86400)
    daily = events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))
    new = events.groupBy("actor").agg(F.min(day).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("new_actors"))
    middle = daily.agg(F.percentile("n", F.lit(0.5)).alias("mid"))
    out = daily.join(new, "day", "left").crossJoin(F.broadcast(middle))
    return out.select("day", "n", "actors", F.coalesce("new_actors", F.lit(0)).alias("new_actors"), (F.col("n") >= F.greatest(F.lit(100.0), 3 * F.col("mid"))).alias("spike"))
