"""Order-based operators: as-of joins, sessions, episodes, bursts, runs, neighbours.

Each partitions by its key and sorts within; windows stream over their rows, and folds see one island of a key only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], carry: list[str], allow_equal: bool = True, time: str = "t", order: str = "id") -> DataFrame:
    """Every left row with carry of the last right row of its key at or before (or strictly before) its time, as-of columns prefixed r_."""
    side = F.lit(1 if allow_equal else 0)
    held = F.struct(F.col(time).alias(time), *[F.col(c).alias(c) for c in carry])
    one = left.select(*left.columns, side.alias("_side"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("_r"), F.lit(None).cast("long").alias("_o"))
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in (*keys, time) else F.col(c) for c in left.columns]
    two = right.select(*empty, F.lit(0 if allow_equal else 1).alias("_side"), held.alias("_r"), F.col(order).cast("long").alias("_o"))
    w = Window.partitionBy(*keys).orderBy(time, "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = one.union(two).withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    return both.filter(F.col("_side") == side).select(*left.columns, *[F.col("_last")[c].alias(f"r_{c}") for c in (time, *carry)])


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, strict: bool = True, time: str = "t", order: str = "id") -> DataFrame:
    """Every left row with r_t and r_id of the first right row of its key after its time (or at it) and within tolerance seconds."""
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in (*keys, time) else F.col(c) for c in left.columns]
    one = left.select(*left.columns, F.lit(None).cast("struct<t:bigint,o:bigint>").alias("_r"))
    two = right.select(*empty, F.struct(F.col(time).cast("long").alias("t"), F.col(order).cast("long").alias("o")).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(1 if strict else 0, tolerance)
    both = one.withColumn("_l", F.lit(True)).union(two.withColumn("_l", F.lit(False))).withColumn("_next", F.min("_r").over(w))
    return both.filter("_l").select(*left.columns, F.col("_next.t").alias("r_t"), F.col("_next.o").alias("r_id"))


def gap_sessions(df: DataFrame, keys: list[str], gap: int, name: str = "session", time: str = "t", order: str = "id") -> DataFrame:
    """Rows numbered by session: a new one where more than gap seconds have passed."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stretches(df: DataFrame, key: str = "actor", gap: int = 900, span: int = 3600) -> DataFrame:
    """One row per stretch: key, start_t, end_t, n, ids. A stretch ends at a pause over gap, or when an event is over span after its start.

    Pauses are cut by a window. Inside an island without pauses that is longer than span the cuts depend on earlier ones: a fold over its times
    finds where stretches start, and rows take the last start before them. No row is copied more than once.
    """
    islands = gap_sessions(df.select(key, "t", "id"), [key], gap, "island")
    island = [key, "island"]
    times = islands.groupBy(*island).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.array_sort(F.collect_set("t")).alias("ts")).filter(F.col("b") - F.col("a") > span)
    zero = F.struct(F.col("a").alias("start"), F.array().cast("array<bigint>").alias("cuts"))
    fold = F.aggregate("ts", zero, lambda acc, t: F.when(t - acc["start"] > span, F.struct(t.alias("start"), F.concat(acc["cuts"], F.array(t)).alias("cuts"))).otherwise(acc), lambda acc: acc["cuts"])
    cuts = times.select(*island, F.explode(fold).alias("t")).withColumn("cut", F.lit(1))
    w = Window.partitionBy(*island)
    running = w.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max(F.when(F.col("cut") == 1, F.col("t"))).over(running), F.min("t").over(w))
    rows = islands.join(cuts, [*island, "t"], "left").select(key, "island", "t", "id", start.alias("start_t"))
    out = rows.groupBy(key, "island", "start_t").agg(F.max("t").alias("end_t"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("ids"))
    return out.select(key, "start_t", "end_t", "n", "ids")


def episodes(df: DataFrame, keys: list[str], pause: int, time: str = "t", order: str = "id") -> DataFrame:
    """Rows that follow the previous of their key by at least pause, and first ones."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    return df.withColumn("_p", F.lag(time).over(w)).filter(F.col("_p").isNull() | (F.col(time) - F.col("_p") >= pause)).drop("_p")


def burst(df: DataFrame, keys: list[str], width: int, time: str = "t") -> DataFrame:
    """For each key the most events within width seconds of one of them, and the first such start."""
    w = Window.partitionBy(*keys).orderBy(time).rangeBetween(0, width)
    counted = df.withColumn("_c", F.count(F.lit(1)).over(w))
    return counted.groupBy(*keys).agg(F.max("_c").alias("most"), F.max_by(time, F.struct("_c", -F.col(time))).alias("start_t"))


def next_of_key(df: DataFrame, keys: list[str], within: int, time: str = "t", order: str = "id") -> DataFrame:
    """u, v: each row and the next of its key, if within seconds later."""
    w = Window.partitionBy(*keys).orderBy(time, order)
    return df.select(F.col(order).alias("u"), F.lead(order).over(w).alias("v"), (F.lead(time).over(w) - F.col(time)).alias("lag")).filter(F.col("lag") <= within)


def next_other_actor(df: DataFrame, place: str, within: int) -> DataFrame:
    """u, v: each row and the first later row of its place by another actor, by (t, id), if within seconds.

    Runs of one actor are islands; the first row of the next island is by another.
    """
    w = Window.partitionBy(place).orderBy("t", "id")
    marked = df.withColumn("_new", F.coalesce((F.col("actor") != F.lag("actor").over(w)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    firsts = marked.filter("_new = 1").select(F.col(place).alias("_p"), (F.col("_run") - 1).alias("_r"), F.col("id").alias("v"), F.col("t").alias("vt"))
    joined = marked.join(firsts, (F.col(place) == F.col("_p")) & (F.col("_run") == F.col("_r")))
    return joined.filter(F.col("vt") - F.col("t") <= within).select(F.col("id").alias("u"), "v")


def previous_others(df: DataFrame, place: str, k: int, within: int) -> DataFrame:
    """u -> v edges: for each row v the last k rows u of other actors in its place, no more than within seconds before, by (t, id), and nth of each.

    Rows fall into runs of one actor. Of the last 2 * k runs before a row's own at least k are others', so the last k rows of each of
    these hold all that is asked for: one pass over the place in order, whatever its length, and no pairs.
    """
    w = Window.partitionBy("p").orderBy("t", "id")
    rows = df.select(F.col(place).alias("p"), "id", "actor", "t")
    rows = rows.withColumn("new", F.when(F.lag("actor").over(w).eqNullSafe(F.col("actor")), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("p", "run").orderBy(F.desc("t"), F.desc("id"))
    tails = rows.withColumn("r", F.row_number().over(back)).filter(F.col("r") <= k)
    packed = tails.groupBy("p", "run", "actor").agg(F.collect_list(F.struct("t", "id")).alias("tail"))
    runs = packed.select("p", "run", F.collect_list(F.struct("actor", "tail")).over(Window.partitionBy("p").orderBy("run").rowsBetween(-2 * k, -1)).alias("before"))
    joined = rows.filter("p is not null").join(runs, ["p", "run"])
    others = F.filter("before", lambda x: x["actor"] != F.col("actor"))
    last = F.sort_array(F.flatten(F.transform(others, lambda x: x["tail"])), asc=False)
    near = F.slice(F.filter(last, lambda x: x["t"] >= F.col("t") - within), 1, k)
    return joined.select(F.col("id").alias("v"), F.posexplode(near).alias("at", "x")).select(F.col("x.id").alias("u"), "v", (F.col("at") + 1).alias("nth"))


def runs(df: DataFrame, keys: list[str], shape: str, least: int) -> DataFrame:
    """Runs of at least `least` rows of one shape, uninterrupted within the key: key, shape, n, start_t, end_t."""
    w = Window.partitionBy(*keys).orderBy("t", "id")
    new = F.coalesce((F.col(shape) != F.lag(shape).over(w)).cast("int"), F.lit(1))
    run = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*keys, "_run", shape).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"))
    return out.filter(F.col("n") >= least).drop("_run")


def median_gap(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median pause between rows of a key, and pauses over max(6 h, ten medians)."""
    w = Window.partitionBy(*keys).orderBy("t", "id")
    gaps = df.withColumn("gap", F.col("t") - F.lag("t").over(w)).filter("gap is not null")
    mid = gaps.groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.count(F.lit(1)).alias("gaps"))
    longer = gaps.join(mid, keys).filter(F.col("gap") > F.greatest(F.lit(21600.0), 10 * F.col("median_gap"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("pauses"))
    return mid.join(longer, keys, "left").na.fill(0, ["pauses"])


def first_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def context(df: DataFrame, place: str, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (one column, id) with the rows up to k places before and after it in its place: focus, id, offset."""
    numbered = df.select(place, "id", F.row_number().over(Window.partitionBy(place).orderBy("t", "id")).alias("at"))
    focus = numbered.join(wanted.select(F.col("id").alias("focus")), F.col("id") == F.col("focus")).select(F.col(place).alias("_p"), "focus", F.explode(F.sequence(F.col("at") - k, F.col("at") + k)).alias("_at"), F.col("at").alias("mid"))
    return numbered.join(focus, (F.col(place) == F.col("_p")) & (F.col("at") == F.col("_at"))).select("focus", "id", (F.col("at") - F.col("mid")).cast("int").alias("offset"))
