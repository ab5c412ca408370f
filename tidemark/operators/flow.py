"""Flow of features along edges between units: state, transmission, adoption, coupling, cascades, regimes.

units: unit, actor, t. has: unit, feature (what a judged unit shows). edges: v (target), u (source); a source must not start later.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .stats import mantel_haenszel, two_proportions, wilson


def earlier(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct edges v, u whose source doesn't start after the target and isn't of the same actor."""
    v = units.select(F.col("unit").alias("v"), F.col("t").alias("tv"), F.col("actor").alias("av"))
    u = units.select(F.col("unit").alias("u"), F.col("t").alias("tu"), F.col("actor").alias("au"))
    return edges.select("v", "u").distinct().join(v, "v").join(u, "u").filter("tu <= tv and au <> av and u <> v").select("v", "u")


def state(units: DataFrame, has: DataFrame, bin_: Column) -> DataFrame:
    """For each feature and bin: n, k, share with its interval, actors that show it for the first time."""
    binned = units.withColumn("bin", bin_)
    n = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    shown = has.join(binned, "unit")
    k = shown.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("k"))
    new = shown.groupBy("feature", "actor").agg(F.min("bin").alias("bin")).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("new_actors"))
    grid = has.select("feature").distinct().crossJoin(F.broadcast(n))
    out = grid.join(k, ["feature", "bin"], "left").join(new, ["feature", "bin"], "left").na.fill(0, ["k", "new_actors"])
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select("feature", "bin", "n", "k", (F.col("k") / F.col("n")).alias("p"), low.alias("lo"), high.alias("hi"), "new_actors")


def strata(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column) -> DataFrame:
    """feature, week, a, n1, c, n0 over targets with a source: exposed means that any source shows the feature.

    Only (target, feature) pairs that occur are made; the rest follow from totals.
    """
    v = edges.select("v").distinct().join(units.select(F.col("unit").alias("v"), week.alias("week")), "v")
    total = v.groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    exposed = edges.join(has.withColumnRenamed("unit", "u"), "u").select("v", "feature").distinct().withColumn("e", F.lit(1))
    own = has.select(F.col("unit").alias("v"), "feature").distinct().join(v.select("v"), "v", "left_semi").withColumn("h", F.lit(1))
    cell = exposed.join(own, ["v", "feature"], "full").join(v, "v").groupBy("feature", "week")
    cell = cell.agg(F.count("e").alias("n1"), F.count_if(F.col("e").isNotNull() & F.col("h").isNotNull()).alias("a"), F.count_if(F.col("e").isNull()).alias("c"))
    return cell.join(total, "week").select("feature", "week", "a", "n1", "c", (F.col("n") - F.col("n1")).alias("n0"))


def observed_expected(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column) -> DataFrame:
    """For each feature, over targets with a source that shows it: observed (those that show it too), expected (their weeks' shares of all units added up), o_e."""
    u = units.select("unit", week.alias("week"))
    rate = has.join(u, "unit").groupBy("feature", "week").agg(F.count_distinct("unit").alias("k")).join(u.groupBy("week").agg(F.count(F.lit(1)).alias("all_n")), "week")
    s = strata(units, has, edges, week).join(rate, ["feature", "week"], "left")
    out = s.groupBy("feature").agg(F.sum("a").alias("observed"), F.sum(F.col("n1") * F.coalesce(F.col("k") / F.col("all_n"), F.lit(0.0))).alias("expected"))
    return out.withColumn("o_e", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")))


def ranking(ratios: DataFrame, least: int = 5, above: float = 1.0) -> DataFrame:
    """Features by the low end of their ratio, of those with `least` exposed cases and a low end over `above`: place."""
    good = ratios.filter((F.col("exposed_with") >= least) & (F.col("lo") > above))
    return good.withColumn("place", F.row_number().over(Window.orderBy(F.desc("lo"), "feature")))  # a row for each feature


def held_out(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column, test: Column, least: int = 5) -> DataFrame:
    """feature, exposed_with, rr, lo, hi of the transmission to targets of the test part only, and its verdict: holds, contradicted, undecided or too few cases."""
    part = edges.join(units.filter(test).select(F.col("unit").alias("v")), "v", "left_semi")
    r = transmission(units, has, part, week)
    verdict = F.when((F.col("exposed_with") < least) | F.col("lo").isNull(), "too few cases").when(F.col("lo") > 1, "holds").when(F.col("hi") < 1, "contradicted").otherwise("undecided")
    return r.select("feature", "exposed_with", "rr", "lo", "hi", verdict.alias("verdict"))


def described(units: DataFrame, has: DataFrame, inside: Column, least: int = 5, z: float = 2.0, top: int = 5) -> DataFrame:
    """What sets a window apart: features with `least` units in it and a z of `z` or more against the rest, by lift over all units: feature, share, elsewhere, lift, z."""
    u = units.select("unit", inside.alias("inside"))
    n = u.agg(F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("rest"))
    k = has.select("unit", "feature").distinct().join(u, "unit").groupBy("feature").agg(F.count_if("inside").alias("k"), F.count_if(~F.col("inside")).alias("k_rest"))
    x = k.crossJoin(F.broadcast(n))  # one row
    out = x.select("feature", "k", (F.col("k") / F.col("n")).alias("share"), (F.col("k_rest") / F.col("rest")).alias("elsewhere"), ((F.col("k") / F.col("n")) / ((F.col("k") + F.col("k_rest")) / (F.col("n") + F.col("rest")))).alias("lift"), two_proportions(F.col("k"), F.col("n"), F.col("k_rest"), F.col("rest")).alias("z"))
    good = out.filter((F.col("k") >= least) & (F.col("z") >= z))
    return good.withColumn("place", F.row_number().over(Window.orderBy(F.desc("lift"), "feature"))).filter(F.col("place") <= top).drop("k")  # a row for each feature


def transmission(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column) -> DataFrame:
    """Risk ratio of showing a feature with and without a source that shows it, over weeks of the target."""
    return mantel_haenszel(strata(units, has, edges, week), ["feature"])


def adoption(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column) -> DataFrame:
    """As transmission, over targets whose actor hasn't shown the feature before; unconnected targets count as unexposed."""
    u = units.select("unit", "actor", "t", week.alias("week"))
    own = has.select("unit", "feature").distinct()
    first = own.join(u, "unit").groupBy("feature", "actor").agg(F.min("t").alias("first_t"))
    exposed = edges.join(has.withColumnRenamed("unit", "u"), "u").select(F.col("v").alias("unit"), "feature").distinct()

    def before(pairs: DataFrame) -> DataFrame:
        """The pairs of a unit and a feature that its actor hasn't shown before."""
        return pairs.join(u, "unit").join(first, ["feature", "actor"], "left").filter("first_t is null or t <= first_t")

    seen = before(exposed.join(own.withColumn("h", F.lit(1)), ["unit", "feature"], "left")).groupBy("feature", "week").agg(F.count(F.lit(1)).alias("n1"), F.count("h").alias("a"))
    shown = before(own).groupBy("feature", "week").agg(F.count(F.lit(1)).alias("shown"))
    past = u.join(first, "actor").filter("t > first_t").groupBy("feature", "week").agg(F.count(F.lit(1)).alias("past"))
    total = u.groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    cell = seen.join(total, "week").join(shown, ["feature", "week"], "left").join(past, ["feature", "week"], "left").na.fill(0, ["shown", "past"])
    s = cell.select("feature", "week", "a", "n1", (F.col("shown") - F.col("a")).alias("c"), (F.col("n") - F.col("past") - F.col("n1")).alias("n0"))
    return mantel_haenszel(s, ["feature"])


def coupling(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column, least: int = 5, above: float = 1.0) -> DataFrame:
    """Pairs A -> B, A other than B: risk ratio of B in a target with a source that shows A; at least `least` exposed cases and lo > above."""
    v = edges.select("v").distinct().join(units.select(F.col("unit").alias("v"), week.alias("week")), "v")
    n = v.groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    seen = edges.join(has.withColumnRenamed("unit", "u"), "u").select("v", F.col("feature").alias("a_feature")).distinct().join(v, "v")
    own = has.select(F.col("unit").alias("v"), F.col("feature").alias("b_feature")).distinct().join(v, "v")
    n1 = seen.groupBy("a_feature", "week").agg(F.count(F.lit(1)).alias("n1"))
    b = own.groupBy("b_feature", "week").agg(F.count(F.lit(1)).alias("b"))
    a = seen.join(own.drop("week"), "v").groupBy("a_feature", "b_feature", "week").agg(F.count(F.lit(1)).alias("a"))
    grid = n1.join(b, "week").filter("a_feature <> b_feature").join(a, ["a_feature", "b_feature", "week"], "left").na.fill(0, ["a"]).join(n, "week")
    s = grid.select("a_feature", "b_feature", "week", "a", "n1", (F.col("b") - F.col("a")).alias("c"), (F.col("n") - F.col("n1")).alias("n0"))
    return mantel_haenszel(s, ["a_feature", "b_feature"]).filter((F.col("exposed_with") >= least) & (F.col("lo") > above))


def shift(units: DataFrame, has: DataFrame, before: Column, after: Column) -> DataFrame:
    """Shares of features in two windows with the pooled z."""
    u = units.withColumn("w", F.when(before, 0).when(after, 1)).filter("w is not null")
    n = u.groupBy().agg(F.count_if(F.col("w") == 0).alias("n0"), F.count_if(F.col("w") == 1).alias("n1"))
    k = has.join(u, "unit").groupBy("feature").agg(F.count_if(F.col("w") == 0).alias("k0"), F.count_if(F.col("w") == 1).alias("k1"))
    out = k.crossJoin(F.broadcast(n))
    return out.select("feature", "k0", "n0", "k1", "n1", two_proportions(F.col("k1"), F.col("n1"), F.col("k0"), F.col("n0")).alias("z"))


def spreaders(units: DataFrame, has: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, actor, pairs: edges from a unit of the actor to a target, both of which show the feature."""
    pair = edges.join(has.withColumnRenamed("unit", "u"), "u").join(has.select(F.col("unit").alias("v"), F.col("feature").alias("f2")), "v").filter("feature = f2")
    return pair.join(units.select(F.col("unit").alias("u"), "actor"), "u").groupBy("feature", "actor").agg(F.count(F.lit(1)).alias("pairs"))


def cascades(units: DataFrame, has: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected groups of two or more units that show a feature: feature, cascade (least unit), units, actors, depth (units on the longest path).

    Labels fall along edges until they settle, then depths rise until none grows; every round is cut to the checkpoint folder.
    Edges that run in a circle have no longest path and raise an error.
    """
    shown = has.select("unit", "feature").distinct()
    pairs = edges.join(shown.withColumnRenamed("unit", "u"), "u").join(shown.select(F.col("unit").alias("v"), F.col("feature").alias("f2")), "v").filter("feature = f2")
    pairs = cut(pairs.select("feature", "v", "u").distinct())
    both = pairs.select("feature", F.col("v").alias("x"), F.col("u").alias("y")).union(pairs.select("feature", "u", "v")).distinct()
    label = cut(both.select("feature", "x").distinct().withColumn("label", F.col("x")))
    moved = True
    while moved:
        near = both.join(label.select("feature", F.col("x").alias("y"), F.col("label").alias("other")), ["feature", "y"]).groupBy("feature", "x").agg(F.min("other").alias("other"))
        jump = label.join(near, ["feature", "x"]).select("feature", "x", F.least("label", "other").alias("m"), "label")
        root = label.select("feature", F.col("x").alias("m"), F.col("label").alias("root"))
        new = cut(jump.join(root, ["feature", "m"]).select("feature", "x", F.least("m", "root").alias("label"), (F.least("m", "root") < F.col("label")).alias("moved")))
        label = new.select("feature", "x", "label")
        moved = bool(new.filter("moved").take(1))
    depth = grown = label.select("feature", "x", F.lit(1).alias("depth"))
    most = label.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most + 1):
        step = pairs.join(grown.select("feature", F.col("x").alias("u"), (F.col("depth") + 1).alias("d")), ["feature", "u"]).groupBy("feature", F.col("v").alias("x")).agg(F.max("d").alias("d"))
        new = cut(depth.join(step, ["feature", "x"], "left").select("feature", "x", F.greatest("depth", F.coalesce("d", F.lit(1))).alias("depth"), (F.col("d") > F.col("depth")).alias("grew")))
        depth = new.select("feature", "x", "depth")
        grown = new.filter("grew").select("feature", "x", "depth")
        if not grown.take(1):
            break
    else:
        raise RuntimeError("the edges of cascades run in a circle")
    joined = label.join(depth, ["feature", "x"]).join(units.select(F.col("unit").alias("x"), "actor"), "x")
    return joined.groupBy("feature", F.col("label").alias("cascade")).agg(F.count(F.lit(1)).alias("units"), F.count_distinct("actor").alias("actors"), F.max("depth").alias("depth"))


def verdict(cases: Column, lo: Column, hi: Column, least: int = 10) -> Column:
    return F.when(cases < least, F.lit("too few")).when(lo > 1, F.lit("holds")).when(hi < 1, F.lit("contradicted")).otherwise(F.lit("undecided"))


def _segment(counts: np.ndarray, n: np.ndarray, least: float, most: int) -> tuple[list[float], list[list[int]]]:
    """Exact least-squares segmentation of days for each number of segments: errors and cuts."""
    days = len(n)
    c, m = np.vstack([np.zeros(counts.shape[1]), counts.cumsum(0)]), np.concatenate([[0], n.cumsum()])
    cost = np.full((days + 1, days + 1), np.inf)
    for i in range(days):
        size = m[i + 1 :] - m[i]
        total = c[i + 1 :] - c[i]
        ok = size >= least
        cost[i, i + 1 :][ok] = (total[ok].sum(1) - (total[ok] ** 2).sum(1) / size[ok]) if ok.any() else np.inf
    best, back = cost[0].copy(), []
    errors, cuts = [float(best[days])], [[]]
    for _ in range(1, most):
        through = best[:, None] + cost
        back.append(through.argmin(0))
        best = through.min(0)
        errors.append(float(best[days]))
        at, found = days, []
        for b in reversed(back):
            at = int(b[at])
            found.append(at)
        cuts.append(found[::-1])
    return errors, cuts


def regimes(units: DataFrame, has: DataFrame, most: int = 8, tolerance: float = 0.001) -> list[dict]:
    """Cuts of the record into periods of steady feature shares: the fewest whose split-half error is within tolerance of the best.

    Days by features are counted in Spark (for each half of the units, by hash); the exact dynamic programme over days runs on the
    driver, whose input is days times features, whatever the number of units.
    """
    half = F.conv(F.substring(F.md5(F.col("unit").cast("string")), 1, 2), 16, 10).cast("long") % 2
    u = units.select("unit", F.floor(F.col("t") / 86400).alias("day"), half.alias("half"))
    n = {(r["day"], r["half"]): r["n"] for r in u.groupBy("day", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    k = has.join(u, "unit").groupBy("day", "half", "feature").agg(F.count(F.lit(1)).alias("k")).collect()
    days, features = sorted({d for d, _ in n}), sorted({r["feature"] for r in k}, key=str)
    if not days or not features:
        return []
    size, count = np.zeros((2, len(days))), np.zeros((2, len(days), len(features)))
    for (d, h), x in n.items():
        size[h, days.index(d)] = x
    for r in k:
        count[r["half"], days.index(r["day"]), features.index(r["feature"])] = r["k"]
    whole_n, whole = size.sum(0), count.sum(0)
    least = max(25.0, 0.03 * whole_n.sum())
    most = min(most, len(days))
    held = np.zeros(most)
    for h in (0, 1):
        errors, cuts = _segment(count[h], size[h], least / 2, most)
        for j in range(most):
            if not np.isfinite(errors[j]):
                held[j] = np.inf
                continue
            edges = [0, *cuts[j], len(days)]
            for a, b in zip(edges, edges[1:], strict=False):
                fit = count[h, a:b].sum(0) / max(size[h, a:b].sum(), 1)
                o, m = count[1 - h, a:b].sum(0), size[1 - h, a:b].sum()
                held[j] += float((o - 2 * fit * o + m * fit**2).sum())
    good = [j for j in range(most) if held[j] <= np.nanmin(held) + tolerance * held[0]]
    errors, cuts = _segment(whole, whole_n, least, most)
    choice = next((j for j in good if np.isfinite(errors[j])), 0)
    edges = [0, *cuts[choice], len(days)] if np.isfinite(errors[choice]) else [0, len(days)]
    return [{"start_day": int(days[a]), "end_day": int(days[b - 1]), "units": int(whole_n[a:b].sum()), "shares": {str(f): float(whole[a:b, i].sum() / max(whole_n[a:b].sum(), 1)) for i, f in enumerate(features)}} for a, b in zip(edges, edges[1:], strict=False)]


def week_of(t: Column) -> Column:
    return F.floor((t - 4 * 86400) / 604800).cast("long")


__all__ = ["adoption", "cascades", "coupling", "earlier", "regimes", "shift", "spreaders", "state", "strata", "transmission", "verdict", "week_of"]
