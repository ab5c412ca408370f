"""Influence: penalised logistic models of showing f on having a source that shows g, with week effects; branching and its radius.

Rows with one design are counted in Spark first, so a model's input is the number of distinct designs, not of units.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors of y successes in n cases by Newton steps with an L2 penalty for each coefficient."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - n * p) - penalty * beta
        info = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(info + 1e-9 * np.eye(len(beta)), gradient)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info + 1e-9 * np.eye(len(beta)))))


def designs(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column) -> DataFrame:
    """f, week, sources' features (sorted array), n, k: counts of units with a source, and of those that show f."""
    seen = edges.join(has.withColumnRenamed("unit", "u"), "u").select(F.col("v").alias("unit"), "feature").distinct()
    near = seen.groupBy("unit").agg(F.array_sort(F.collect_set("feature")).alias("near"))
    base = units.select("unit", week.alias("week")).join(near, "unit")
    own = has.groupBy("unit").agg(F.collect_set("feature").alias("own"))
    cells = base.join(own, "unit", "left").groupBy("week", "near", F.array_sort(F.coalesce("own", F.array().cast("array<string>"))).alias("own"))
    return cells.agg(F.count(F.lit(1)).alias("n"))


def links(units: DataFrame, has: DataFrame, edges: DataFrame, week: Column, ridge: float = 1.0, week_ridge: float = 0.1, level: float = 0.05) -> DataFrame:
    """f, g, alpha, z, p, passes (Benjamini-Hochberg), dp: the change in the chance of f when a source shows g.

    The features are a short list; the driver gets one row for each distinct (week, near, own).
    """
    rows = designs(units, has, edges, week).collect()
    spark = units.sparkSession
    schema = "f string, g string, alpha double, z double, p double, dp double, passes boolean"
    names = sorted({g for r in rows for g in (*r["near"], *r["own"])})
    weeks = sorted({r["week"] for r in rows})
    if not rows or not names:
        return spark.createDataFrame([], schema)
    x = np.array([[1.0, *[float(r["week"] == w) for w in weeks], *[float(g in r["near"]) for g in names]] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    penalty = np.array([1e-6, *[week_ridge] * len(weeks), *[ridge] * len(names)])
    out = []
    for f in names:
        y = np.array([r["n"] * (f in r["own"]) for r in rows], float)
        beta, se = logistic(x, y, n, penalty)
        for j, g in enumerate(names, 1 + len(weeks)):
            z = beta[j] / se[j]
            on, off = x.copy(), x.copy()
            on[:, j], off[:, j] = 1, 0
            chance = lambda m: float((n / (1 + np.exp(-(m @ beta)))).sum() / n.sum())  # noqa: E731, B023
            out.append([f, g, float(beta[j]), float(z), math.erfc(abs(z) / math.sqrt(2)), chance(on) - chance(off)])
    order = sorted(range(len(out)), key=lambda i: out[i][4])
    cut = max((out[i][4] for k, i in enumerate(order, 1) if out[i][4] <= level * k / len(out)), default=-1.0)
    return spark.createDataFrame([(*[round(v, 9) if isinstance(v, float) else v for v in r], r[4] <= cut) for r in out], schema)


def branching(links_: list[tuple[str, str, float]], contacts: dict[str, float]) -> tuple[float, np.ndarray | None]:
    """Spectral radius of G = max(0, dp) * contacts of the source feature, and (I - G)^-1 - I if the radius is below 0.99."""
    names = sorted({x for f, g, _ in links_ for x in (f, g)})
    m = np.zeros((len(names), len(names)))
    for f, g, dp in links_:
        m[names.index(g), names.index(f)] = max(0.0, dp) * contacts.get(g, 0.0)
    radius = float(np.abs(np.linalg.eigvals(m)).max()) if len(m) else 0.0
    return radius, np.linalg.inv(np.eye(len(m)) - m) - np.eye(len(m)) if radius < 0.99 else None
