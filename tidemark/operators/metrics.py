"""Metrics with baselines: rates against all others, ranks, before and after, boards, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_vs_others(events: DataFrame, hit: Column, by: str = "actor") -> DataFrame:
    """Each key's share of hits against that of all others together."""
    own = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"))
    total = own.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"))
    out = own.crossJoin(F.broadcast(total))
    rate, others = F.col("k") / F.col("n"), (F.col("all_k") - F.col("k")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    return out.select(by, "n", "k", rate.alias("rate"), others.alias("others"), F.when(others > 0, rate / others).alias("lift"))


def volume_rank(events: DataFrame, by: str = "actor") -> DataFrame:
    """n, rank (largest first, equal ones share), population z, median of the others (null without others).

    Without one key the order statistics move up by one from that key's place on, so a few of them, taken once, serve all keys.
    """
    own = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    whole = own.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.count(F.lit(1)).alias("keys"))
    ranks = own.groupBy("n").agg(F.count(F.lit(1)).alias("c")).withColumn("rank", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    whole = whole.withColumn("low", F.floor((F.col("keys") - 2) / 2)).withColumn("high", F.floor((F.col("keys") - 1) / 2))
    upto = ranks.crossJoin(whole).withColumn("last", F.col("keys") - F.col("rank"))  # the ascending place, from 0, of the last key with n
    at = [F.min(F.when(F.col("last") >= F.col(x) + k, F.col("n"))).alias(f"{x}{k}") for x in ("low", "high") for k in (0, 1)]
    whole = upto.groupBy("mean", "sd", "keys", "low", "high").agg(*at)
    out = own.join(ranks.select("n", "rank"), "n").crossJoin(F.broadcast(whole))  # one row
    of_others = [F.when(F.col(x) < F.col("keys") - F.col("rank"), F.col(f"{x}0")).otherwise(F.col(f"{x}1")) for x in ("low", "high")]
    median = F.when(F.col("keys") > 1, (of_others[0] + of_others[1]) / 2)
    return out.select(by, "n", "rank", F.when(F.col("sd") > 0, (F.col("n") - F.col("mean")) / F.col("sd")).alias("z"), median.alias("median_n"))


def before_after(events: DataFrame, at: int, days: int, by: str = "actor") -> DataFrame:
    """Events, active hours and events per active hour in the days before at and from it on, and the ratio of counts."""
    near = events.filter((F.col("t") >= at - days * 86400) & (F.col("t") < at + days * 86400))
    before, hour = F.col("t") < at, F.floor(F.col("t") / 3600)
    out = near.groupBy(by).agg(
        F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"),
        F.greatest(F.count_distinct(F.when(before, hour)), F.lit(1)).alias("hours_before"), F.greatest(F.count_distinct(F.when(~before, hour)), F.lit(1)).alias("hours_after"),
    )
    return out.withColumn("ratio", F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before"))).withColumn("per_hour_before", F.col("n_before") / F.col("hours_before")).withColumn("per_hour_after", F.col("n_after") / F.col("hours_after"))


def outliers(events: DataFrame, label: str = "kind", by: str = "actor", least: int = 8, factor: float = 2.0, margin: float = 0.2) -> DataFrame:
    """Shares of labels that stand out: n >= least, share >= max(factor * base, base + margin), the base being all others."""
    cell = events.groupBy(by, label).agg(F.count(F.lit(1)).alias("k"))
    own = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    kinds = events.groupBy(label).agg(F.count(F.lit(1)).alias("all_k"))
    total = events.agg(F.count(F.lit(1)).alias("all_n"))
    joined = cell.join(own, by).join(kinds, label).crossJoin(F.broadcast(total))
    share, base = F.col("k") / F.col("n"), (F.col("all_k") - F.col("k")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    out = joined.select(by, label, "n", "k", share.alias("share"), base.alias("base"))
    return out.filter((F.col("n") >= least) & (F.col("share") >= F.greatest(factor * F.col("base"), F.col("base") + margin)))


def dominant(events: DataFrame, label: str = "kind", least: float = 0.15) -> DataFrame:
    n = events.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))
    total = events.agg(F.count(F.lit(1)).alias("all_n"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", "actors", (F.col("n") / F.col("all_n")).alias("share"), (F.col("n") / F.col("all_n") >= least).alias("dominant"))


def distinctive(events: DataFrame, period: Column, label: str = "kind", lift: float = 1.5, least: int = 8) -> DataFrame:
    """Labels over their usual share in a period: lift and score = lift * ln(1 + n)."""
    e = events.withColumn("period", period)
    cell = e.groupBy("period", label).agg(F.count(F.lit(1)).alias("n"))
    own, kinds, total = e.groupBy("period").agg(F.count(F.lit(1)).alias("v")), e.groupBy(label).agg(F.count(F.lit(1)).alias("all_k")), e.agg(F.count(F.lit(1)).alias("all_v"))
    joined = cell.join(own, "period").join(kinds, label).crossJoin(F.broadcast(total))
    value = (F.col("n") / F.col("v")) / (F.col("all_k") / F.col("all_v"))
    return joined.select("period", label, "n", value.alias("lift"), (value * F.log1p("n")).alias("score")).filter((F.col("lift") >= lift) & (F.col("n") >= least))


def daily_bursts(events: DataFrame, keys: list[str], factor: float = 3.0, level: float = 1e-4) -> DataFrame:
    """Days on which a key has at least factor times its mean of the other days and a Poisson tail below level.

    The mean runs over the days between the key's first and last. The tail is a fold over a sequence, inside the JVM.
    """
    daily = events.groupBy(*keys, F.floor(F.col("t") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    span = F.max("day").over(w) - F.min("day").over(w) + 1
    cast = daily.withColumn("mean_other", F.when(span > 1, (F.sum("n").over(w) - F.col("n")) / (span - 1)))
    big = cast.filter((F.col("mean_other") > 0) & (F.col("n") >= factor * F.col("mean_other")))
    m = F.col("mean_other")
    zero = F.struct(F.exp(-m).alias("term"), F.lit(0.0).alias("total"))
    fold = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("n")), zero, lambda acc, k: F.struct((acc["term"] * m / k).alias("term"), (acc["total"] + acc["term"]).alias("total")), lambda acc: F.greatest(F.lit(0.0), 1 - acc["total"]))
    return big.withColumn("tail", fold).filter(F.col("tail") < level)


def profile_bins(units: DataFrame, feature: str, bin_: Column, value: str = "v") -> DataFrame:
    """Per feature and bin: the mean of value over the bin's units, counts of units and actors, for all bins between the first and last, quiet ones too."""
    u = units.withColumn("bin", bin_)
    bins = u.groupBy("bin").agg(F.count_distinct("unit").alias("units"), F.count_distinct("actor").alias("actors"))
    edges = u.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    calendar = edges.select(F.explode(F.sequence("a", "b")).alias("bin"))
    sums = u.groupBy(feature, "bin").agg(F.sum(value).alias("total"))
    grid = u.select(feature).distinct().crossJoin(F.broadcast(calendar))
    return grid.join(bins, "bin", "left").join(sums, [feature, "bin"], "left").select(feature, "bin", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("actors", F.lit(0)).alias("actors"), F.when(F.col("units") > 0, F.coalesce("total", F.lit(0.0)) / F.col("units")).alias("rate"))


def zoom(events: DataFrame, *levels: str) -> DataFrame:
    """Counts of the record by each level of a roll-up; null stands for all."""
    return events.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))


def incidents(events: DataFrame, keys: list[str], gap: int = 1800) -> DataFrame:
    from .sequences import gap_sessions

    s = gap_sessions(events, keys, gap, "incident")
    return s.groupBy(*keys, "incident").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count_distinct("kind").alias("kinds"))


def lower_percentile(df: DataFrame, column: str, q: float) -> DataFrame:
    """The order statistic at int(q * (n - 1)), by counts of distinct values."""
    by = df.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    run = by.withColumn("upto", F.sum("c").over(Window.orderBy(column))).crossJoin(F.broadcast(df.agg(F.count(column).alias("_all"))))
    return run.filter(F.col("upto") > F.floor(q * (F.col("_all") - 1))).agg(F.min(column).alias("value"))
