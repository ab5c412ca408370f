"""Claims about behaviour: what follows what by scope, spread along contacts, joint occurrence, and verdicts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranges import near_windows

OFF = (-3, -2, 2, 3)
RESAMPLES = 300


def after_then_cases(events: DataFrame, a: Column, b: Column, width: int, scope: str = "same_actor", targets: DataFrame | None = None) -> DataFrame:
    """One row for each A event: id, t, group, active (somebody to respond was active in the width seconds after), hit (a B event among theirs),
    base_windows and base_hits of the windows shifted by OFF widths, where the candidates' records span the window and they were active.

    scope: same_actor; target (targets: id, target; those other than the actor; group is the least); others_same_place (other actors of the channel).
    """
    cases = events.filter(a).select("id", "t", F.col("actor").alias("ta"), "channel")
    members = events.withColumn("key", F.col("channel") if scope == "others_same_place" else F.col("actor"))
    if scope == "target":
        known = members.select(F.col("key").alias("target")).distinct()
        keyed = cases.join(targets.select("id", "target").distinct().join(known, "target", "left_semi"), "id").filter("target <> ta").withColumnRenamed("target", "key")
    else:
        keyed = cases.withColumn("key", F.col("channel") if scope == "others_same_place" else F.col("ta")).filter("key is not null")
    seen = near_windows(keyed.select("id", "t", "ta", "key"), members, ["key"], width, (0, *OFF), {"active": F.lit(True), "hit": b}, scope == "others_same_place")
    whole = Window.partitionBy("id")
    seen = seen.withColumn("first_t", F.min("first_t").over(whole)).withColumn("last_t", F.max("last_t").over(whole))
    flags = []
    for i, k in enumerate((0, *OFF)):
        fits = F.lit(True) if k == 0 else (F.col("t") + k * width >= F.col("first_t")) & (F.col("t") + (k + 1) * width <= F.col("last_t"))
        flags += [F.max(F.when(fits & F.col(x)[i], 1).otherwise(0)).alias(f"{x}_{i}") for x in ("active", "hit")]
    out = seen.groupBy("id").agg(F.min("t").alias("t"), F.min("key" if scope == "target" else "ta").alias("group"), *flags)
    added = lambda x: sum(F.col(f"{x}_{i}") for i in range(1, len(OFF) + 1)).cast("long")
    return out.select("id", "group", "t", (F.col("active_0") > 0).alias("active"), F.col("hit_0").alias("hit"), added("active").alias("base_windows"), added("hit").alias("base_hits"))


def after_then(cases: DataFrame, seed: int = 5) -> DataFrame:
    """One row over cases with a baseline of their own: cases, unpaired, silent, groups, rate, base, cases and gap by half of time, gap_ci_low.

    gap_ci_low is the lower 5 % point of the gap over resamples of whole groups, by a hash instead of a generator's state; null where the gap is below
    0.05, there are fewer than 15 cases, or no cases at all.
    """
    cases = cut(cases.select("group", "t", "active", "hit", "base_windows", "base_hits"))  # read five times
    good = cases.filter("active and base_windows > 0")
    times = good.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    run = times.withColumn("upto", F.sum("c").over(Window.orderBy("t"))).withColumn("total", F.sum("c").over(Window.partitionBy()))  # a row for each time
    middle = run.filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("t").alias("mid"))
    halved = good.crossJoin(F.broadcast(middle)).withColumn("late", F.col("t") >= F.col("mid"))  # one row

    def gap(where: Column) -> Column:
        pick = lambda c: F.sum(F.when(where, F.col(c)))
        return pick("hit") / F.count_if(where) - pick("base_hits") / pick("base_windows")

    counts = cases.agg(F.count_if(F.col("active") & (F.col("base_windows") == 0)).alias("unpaired"), F.count_if(~F.col("active")).alias("silent"))
    whole = halved.agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("group").alias("groups"), F.avg("hit").alias("rate"), (F.sum("base_hits") / F.sum("base_windows")).alias("base"),
        F.count_if(~F.col("late")).alias("cases_1"), gap(~F.col("late")).alias("gap_1"), F.count_if("late").alias("cases_2"), gap(F.col("late")).alias("gap_2"),
    )
    groups = good.groupBy("group").agg(F.count(F.lit(1)).alias("c"), F.sum("hit").alias("f"), F.sum("base_hits").alias("bh"), F.sum("base_windows").alias("bn"))
    groups = groups.withColumn("i", F.row_number().over(Window.orderBy("group")) - 1).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))  # a row for each group
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "r", "i")), 1, 8), 16, 10).cast("long") % F.col("size")
    enough = (F.col("cases") >= 15) & (F.col("rate") - F.col("base") >= 0.05)
    groups = groups.crossJoin(F.broadcast(whole.filter(enough).select(F.lit(1).alias("wanted")))).repartition("i")  # one row or none: without a gap nothing is drawn
    draws = groups.select("i", "size", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("r")).select("r", draw.alias("i"))
    sums = draws.join(groups.select("i", "c", "f", "bh", "bn"), "i").groupBy("r").agg(*[F.sum(x).alias(x) for x in ("c", "f", "bh", "bn")])
    gaps = sums.select((F.col("f") / F.col("c") - F.col("bh") / F.col("bn")).alias("d"))
    low = gaps.agg(F.sort_array(F.collect_list("d")).alias("ds")).select(F.try_element_at("ds", (F.floor(0.05 * F.size("ds")) + 1).cast("int")).alias("low"))  # RESAMPLES numbers
    return whole.crossJoin(counts).crossJoin(low).withColumn("gap_ci_low", F.when(enough, F.col("low"))).drop("low")  # one row each


def after_then_verdict() -> Column:
    """holds, not_holds or insufficient, of a row of after_then."""
    halves = lambda test: test("1") & test("2")
    few = (F.col("cases") < 15) | (F.col("groups") < 4) | F.col("base").isNull() | ~halves(lambda h: (F.col(f"cases_{h}") >= 5) & F.col(f"gap_{h}").isNotNull())
    lift = F.when(F.col("base") < 0.01, F.col("rate") >= 0.10).otherwise(F.col("rate") / F.col("base") >= 1.5)
    good = (F.col("rate") - F.col("base") >= 0.10) & lift & halves(lambda h: F.round(F.col(f"gap_{h}"), 3) >= 0.03) & (F.coalesce("gap_ci_low", F.lit(0.0)) > 0)
    return F.when(few, "insufficient").when(good, "holds").otherwise("not_holds")


def co_occurrence(events: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: actors with A, with B, with both; share of A's actors that have B, and base, the share of all actors; the same by half of the actors' hashes."""
    own = events.groupBy("actor").agg(F.max(a).alias("a"), F.max(b).alias("b"))
    half = F.conv(F.substring(F.md5(F.col("actor").cast("string")), 32, 1), 16, 10).cast("int") % 2
    own = own.withColumn("half", half)

    def part(where: Column, name: str) -> list[Column]:
        n_a, n_b, both, n = F.count_if(where & F.col("a")), F.count_if(where & F.col("b")), F.count_if(where & F.col("a") & F.col("b")), F.count_if(where)
        return [n_a.alias(f"a_actors{name}"), n_b.alias(f"b_actors{name}"), both.alias(f"both{name}"), F.when(n_a > 0, both / n_a).alias(f"share{name}"), F.when(n > 0, n_b / n).alias(f"base{name}")]

    return own.agg(*part(F.lit(True), ""), *part(F.col("half") == 0, "_1"), *part(F.col("half") == 1, "_2"))


def co_occurrence_verdict() -> Column:
    halves = lambda test: test("1") & test("2")
    few = (F.col("a_actors") < 8) | (F.col("b_actors") < 8) | (F.col("both") < 5)
    few = few | ~halves(lambda h: (F.col(f"a_actors_{h}") >= 4) & (F.coalesce(f"base_{h}", F.lit(0.0)) > 0))
    lift = lambda h: F.col(f"share{h}") / F.nullif(F.col(f"base{h}"), F.lit(0.0))
    good = (lift("") >= 1.5) & (F.col("share") - F.col("base") >= 0.1) & halves(lambda h: lift(f"_{h}") >= 1.2)
    return F.when(few, "insufficient").when(good, "holds").otherwise("not_holds")


def spread(events: DataFrame, contacts: DataFrame, uses: Column) -> DataFrame:
    """One row: adopters, linked (share of them but the first that had contact with an earlier adopter before their first use), base (the mean, over these
    moments, of that share among the actors active by then that had not adopted). contacts: src, dst, t, either way.

    Everybody's link starts at a time of their own, so base comes from running sums of starts and ends over a row for each moment; no pairs of
    adopters and others are made. Equal times don't count as earlier.
    """
    first = events.filter(uses).groupBy("actor").agg(F.min("t").alias("use_t"))
    both = contacts.select(F.col("src").alias("actor"), F.col("dst").alias("other"), "t").union(contacts.select("dst", "src", "t")).groupBy("actor", "other").agg(F.min("t").alias("met"))
    link = both.join(first.select(F.col("actor").alias("other"), F.col("use_t").alias("other_t")), "other").groupBy("actor").agg(F.min(F.greatest("met", "other_t")).alias("link_t"))
    known = events.groupBy("actor").agg(F.min("t").alias("seen_t")).join(first, "actor", "left").join(link, "actor", "left")
    known = known.withColumn("linked_t", F.greatest("seen_t", F.col("link_t") + F.lit(0)))
    known = known.withColumn("linked_t", F.when(F.col("link_t").isNotNull(), F.col("linked_t")))
    moves = [
        (F.col("seen_t"), 1, 0, F.lit(True)), (F.col("use_t"), -1, 0, F.col("use_t").isNotNull()), (F.col("linked_t"), 0, 1, F.col("linked_t").isNotNull()),
        (F.greatest("use_t", "linked_t"), 0, -1, F.col("linked_t").isNotNull() & F.col("use_t").isNotNull()),
    ]
    steps = None
    for t, pool, linked, where in moves:
        one = known.filter(where).select(t.alias("t"), F.lit(pool).alias("pool"), F.lit(linked).alias("linked"))
        steps = one if steps is None else steps.union(one)
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    run = steps.groupBy("t").agg(F.sum("pool").alias("pool"), F.sum("linked").alias("linked"))
    run = run.select("t", F.coalesce(F.sum("pool").over(before), F.lit(0)).alias("pool"), F.coalesce(F.sum("linked").over(before), F.lit(0)).alias("linked"))
    adopters = known.filter("use_t is not null")
    start = adopters.agg(F.min(F.struct("use_t", "actor")).alias("s"), F.count(F.lit(1)).alias("adopters")).select("s.actor", "adopters")
    rest = adopters.join(run, F.col("use_t") == F.col("t")).join(F.broadcast(start.select(F.col("actor").alias("s"))), F.col("actor") != F.col("s"))  # one row
    own_seen, own_link = (F.coalesce(F.col(c) < F.col("use_t"), F.lit(False)).cast("int") for c in ("seen_t", "linked_t"))
    pool, linked = F.col("pool") - own_seen, F.col("linked") - own_link
    out = rest.agg(F.avg(F.coalesce(F.col("link_t") < F.col("use_t"), F.lit(False)).cast("int")).alias("linked"), F.avg(F.when(pool > 0, linked / pool)).alias("base"))
    return start.select("adopters").crossJoin(out)  # one row each
