"""Closed-form statistics as column expressions, and small numerics on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval, within [0, 1]; null without cases."""
    p, zz = k / n, z * z
    middle, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def two_proportions(k1: Column, n1: Column, k0: Column, n0: Column) -> Column:
    """Pooled z of two shares; null where undefined."""
    p = (k1 + k0) / (n1 + n0)
    se = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return F.when((n1 > 0) & (n0 > 0) & (se > 0), (k1 / n1 - k0 / n0) / se)


def mantel_haenszel(strata: DataFrame, by: list[str], z: float = Z) -> DataFrame:
    """Risk ratio over strata with the Greenland-Robins interval. strata: by..., a, n1, c, n0 (cases and sizes, exposed and not).

    Strata without one of the groups don't count. To each stratum with an empty cell, be it that none or all of a group show the
    feature, half a case is added in every cell for the ratio; the counts returned are uncorrected.
    """
    good = strata.filter("n1 > 0 and n0 > 0")
    fix = F.when((F.col("a") == 0) | (F.col("a") == F.col("n1")) | (F.col("c") == 0) | (F.col("c") == F.col("n0")), 0.5).otherwise(0.0)
    a, c, n1, n0 = F.col("a") + fix, F.col("c") + fix, F.col("n1") + 2 * fix, F.col("n0") + 2 * fix
    n, m = n1 + n0, a + c
    sums = good.groupBy(*by).agg(
        F.sum("a").alias("exposed_with"), F.sum("n1").alias("exposed"), F.sum("c").alias("unexposed_with"), F.sum("n0").alias("unexposed"),
        F.sum(a * n0 / n).alias("_r"), F.sum(c * n1 / n).alias("_s"), F.sum((m * n1 * n0 - a * c * n) / (n * n)).alias("_p"),
    )
    rr, se = F.col("_r") / F.col("_s"), F.sqrt(F.col("_p") / (F.col("_r") * F.col("_s")))
    return sums.select(*by, "exposed_with", "exposed", "unexposed_with", "unexposed", rr.alias("rr"), (rr * F.exp(-z * se)).alias("lo"), (rr * F.exp(z * se)).alias("hi"))


def benjamini_hochberg(df: DataFrame, p: str, level: float) -> DataFrame:
    """The rows with passes: p at or below the largest p that is within level * rank / n. One row per test."""
    counts = df.groupBy(p).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumn("_top", F.sum("_c").over(Window.orderBy(F.asc(p)))).withColumn("_n", F.sum("_c").over(Window.partitionBy()))
    cut = ranked.agg(F.max(F.when(F.col(p) <= level * F.col("_top") / F.col("_n"), F.col(p))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("passes", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def kappa(both: Column, only_one: Column, only_two: Column, neither: Column) -> Column:
    n = both + only_one + only_two + neither
    po = (both + neither) / n
    pe = ((both + only_one) * (both + only_two) + (neither + only_one) * (neither + only_two)) / (n * n)
    return F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by mean ranks. Equal scores are counted first, so the order runs over distinct scores."""
    by = df.groupBy(score).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("rank", F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2)
    out = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return out.select(F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"), p.alias("positives"), q.alias("negatives"))


def stratified_estimates(strata: DataFrame) -> DataFrame:
    """Weighted precision and recall. strata: size (in the record), n (sampled), pos (true), hit (true and found), found."""
    scale = F.col("size") / F.col("n")
    sums = strata.filter("n > 0").agg(F.sum(scale * F.col("hit")).alias("tp"), F.sum(scale * F.col("found")).alias("found"), F.sum(scale * F.col("pos")).alias("pos"))
    return sums.select((F.col("tp") / F.col("found")).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"), F.col("pos").alias("estimated"))


def poisson_tail(n: int, mean: float) -> float:
    """P(X >= n)."""
    if n <= 0:
        return 1.0
    term, total = math.exp(-mean), 0.0
    for k in range(n):
        total += term
        term *= mean / (k + 1)
    return max(0.0, 1 - total)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of a 2 x 2 table: the sum of probabilities of tables no likelier than this one."""
    rows, columns, n = a + b, a + c, a + b + c + d
    low, high = max(0, rows + columns - n), min(rows, columns)
    log = lambda x: math.lgamma(x + 1)
    weight = [-log(x) - log(rows - x) - log(columns - x) - log(n - rows - columns + x) for x in range(low, high + 1)]
    own, top = weight[a - low], max(weight)
    return min(1.0, sum(math.exp(w - top) for w in weight if w <= own + 1e-9) / sum(math.exp(w - top) for w in weight))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation without averaging ties (ties by the other column)."""
    ra, rb = F.row_number().over(Window.orderBy(a, b)), F.row_number().over(Window.orderBy(b, a))
    return df.select(ra.alias("ra"), rb.alias("rb")).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))
