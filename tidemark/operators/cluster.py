"""Vectors and kinds: standardising, nearest neighbours, PCA, clusters, erasure, a text screener, bootstrap.

Moments and covariances are sums over rows in Spark; only matrices of a vector's width reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def standardise(vectors: DataFrame, width: int, clip: float = 5.0) -> DataFrame:
    """vec_id, i, z: population z by component, within clip, over the root of the width; components without spread are dropped."""
    long = vectors.select("vec_id", F.posexplode("v").alias("i", "x"))
    m = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).filter("s > 1e-9")
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col("x") - F.col("m")) / F.col("s"))) / float(np.sqrt(width))
    return long.join(F.broadcast(m), "i").select("vec_id", "i", z.alias("z"))


def contrasts(vectors: DataFrame, group: str, least: float, top: int) -> DataFrame:
    """Components in which a group's mean stands apart: z of the group mean, the top by size."""
    long = vectors.select(group, F.posexplode("v").alias("i", "x"))
    whole = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = long.groupBy(group, "i").agg(F.avg("x").alias("gm")).join(F.broadcast(whole), "i").select(group, "i", F.round((F.col("gm") - F.col("m")) / F.col("s"), 6).alias("z"))
    w = Window.partitionBy(group).orderBy(F.desc(F.abs("z")), "i")
    return z.filter(F.abs("z") >= least).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).drop("r")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """q_id, vec_id, place: the k nearest other vectors of each query, exactly, by distance and id.

    Queries are cut into blocks; each scan task compares its rows with a block and keeps k for each query, so that
    what is shuffled is k rows for each query and task.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"))
    packed = q.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("q_id", "q"))).alias("qs"))

    out = None
    for row in packed.toLocalIterator():  # one block of bounded size at a time
        ids = np.array([x["q_id"] for x in row["qs"]])
        m = np.array([x["q"] for x in row["qs"]], float)

        def run(batches: Iterator[pd.DataFrame], ids=ids, m=m) -> Iterator[pd.DataFrame]:
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64)) for _ in ids]
            for pdf in batches:
                if not len(pdf):
                    continue
                x, own = np.stack(pdf["v"].map(np.asarray)).astype(float), pdf["vec_id"].to_numpy()
                for j in range(len(ids)):
                    d = np.round(np.sqrt(((x - m[j]) ** 2).sum(1)), 9)
                    keep = own != ids[j]
                    dist, who = np.concatenate([best[j][0], d[keep]]), np.concatenate([best[j][1], own[keep]])
                    order = np.lexsort((who, dist))[:k]
                    best[j] = dist[order], who[order]
            yield pd.DataFrame({"q_id": np.repeat(ids, [len(b[0]) for b in best]), "vec_id": np.concatenate([b[1] for b in best]).astype(np.int64), "d": np.concatenate([b[0] for b in best])})

        part = vectors.select("vec_id", "v").mapInPandas(run, "q_id long, vec_id long, d double")
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "q_id long, vec_id long, place int")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy("d", "vec_id"))).filter(F.col("place") <= k).select("q_id", "vec_id", "place")


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance, from one row for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].map(np.asarray)).astype(float)
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.reshape(-1).tolist()]})

    long = vectors.select("v").mapInPandas(run, "n long, s array<double>, c array<double>").select("n", F.posexplode(F.concat("s", "c")).alias("i", "x"))
    rows = long.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()  # width * (width + 1) numbers
    if not rows:
        return 0, np.empty(0), np.empty((0, 0))
    n, flat = rows[0]["n"], np.array([r["x"] for r in rows])
    width = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    mean = flat[:width] / n
    return n, mean, flat[width:].reshape(width, width) / n - np.outer(mean, mean)


def pca(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id and the first k principal coordinates, scaled to 0..1; signs are fixed by the largest loading."""
    n, mean, cov = moments(vectors)
    names = ["x", "y", *[f"c{j}" for j in range(2, k)]][:k]
    if not n:
        return vectors.sparkSession.createDataFrame([], "vec_id long, " + ", ".join(f"{c} double" for c in names))
    values, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.map(np.asarray)) - mean) @ axes)) if len(v) else pd.Series([], dtype=object)

    flat = vectors.select("vec_id", project("v").alias("p")).select("vec_id", *[F.col("p")[j].alias(c) for j, c in enumerate(names)])
    edges = flat.agg(*[f(c).alias(f"{c}_{g}") for c in names for g, f in (("low", F.min), ("high", F.max))]).first()
    return flat.select("vec_id", *[F.round((F.col(c) - edges[f"{c}_low"]) / max(edges[f"{c}_high"] - edges[f"{c}_low"], 1e-12), 6).alias(c) for c in names])


def kinds(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, kind: bisecting k-means, the scalable stand-in for a Ward tree."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector("v").alias("features"))
    model = BisectingKMeans(k=k, seed=7).fit(rows)
    return model.transform(rows).select("vec_id", F.col("prediction").alias("kind"))


def erasure(n: int, cov_x: np.ndarray, cov_xz: np.ndarray) -> np.ndarray:
    """The matrix that, applied to centred x, removes all linear information about z with the least change (LEACE)."""
    values, axes = np.linalg.eigh(cov_x)
    keep = values > 1e-10
    half = axes[:, keep] * np.sqrt(values[keep]) @ axes[:, keep].T
    inverse = axes[:, keep] / np.sqrt(values[keep]) @ axes[:, keep].T
    u, s, _ = np.linalg.svd(inverse @ cov_xz, full_matrices=False)
    u = u[:, s > 1e-8]
    return np.eye(len(cov_x)) - half @ u @ u.T @ inverse


def screener(rows: DataFrame, features: int = 1 << 16, limit: int | None = None) -> DataFrame:
    """id, score, test: logistic regression on hashed words of rows (id, actor, text, label); actors whose hash is 0 of 5 are held out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    last = F.expr("conv(right(md5(cast(actor as string)), 8), 16, 10)").cast("long")
    words = rows.withColumn("words", tokens(F.col("text"), limit)).withColumn("test", last % 5 == 0)
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True).transform(words)
    share = hashed.filter("not test").agg(F.avg("label")).first()[0] or 0.5
    weight = F.when(F.col("label") == 1, F.lit(float(np.sqrt((1 - share) / max(share, 1e-6))))).otherwise(1.0)
    model = LogisticRegression(maxIter=30, regParam=0.01, weightCol="w").fit(hashed.filter("not test").withColumn("w", weight))
    return model.transform(hashed).select("id", "label", "test", F.round(vector_to_array("probability")[1], 6).alias("score"))


def bootstrap(groups: DataFrame, key: str, k: str, n: str, draws: int) -> DataFrame:
    """5th and 95th percentile of sum(k) / sum(n) over Poisson resamples of groups; a draw's weight comes from a hash, so reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.col("draw")), 12) + 0.5) / float(1 << 52)
    cumulative = np.cumsum([np.exp(-1) / np.prod(range(1, j + 1)) for j in range(8)])
    weight = sum((F.when(u > float(c), 1).otherwise(0) for c in cumulative), F.lit(0))
    drawn = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", weight)
    shares = drawn.groupBy("draw").agg((F.sum(F.col("_w") * F.col(k)) / F.sum(F.col("_w") * F.col(n))).alias("share"))
    return shares.agg(F.percentile("share", F.lit(0.05)).alias("low"), F.percentile("share", F.lit(0.95)).alias("high"), F.count("share").alias("draws"))
