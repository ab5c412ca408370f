"""Overlap of sets: all pairs of owners by the Jaccard of what they hold, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 2048  # owners of a block: a comparison holds a square of so many counts
ITEMS = 2048  # items of one multiplication


def _members(codes: np.ndarray, rows: np.ndarray, n: int, first: int, width: int) -> np.ndarray:
    inside = (codes >= first) & (codes < first + width)
    out = np.zeros((n, width), np.float32)
    out[rows[inside], codes[inside] - first] = 1
    return out


def _compare(least: float, width: int):
    def of(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        sides = [df[df["block"] == x] for x in ((i,) if i == j else (i, j))]
        owners, sizes = [x["owner"].to_numpy() for x in sides], [x["items"].map(len).to_numpy(np.int64) for x in sides]
        flat = [np.concatenate(x["items"].to_numpy()) if len(x) else np.zeros(0, np.int64) for x in sides]
        codes = np.split(np.unique(np.concatenate(flat), return_inverse=True)[1], [len(flat[0])])
        rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
        both = np.zeros((len(owners[0]), len(owners[-1])), np.float32)  # whole numbers, exact up to 16 million
        for first in range(0, max((c.max() + 1 for c in codes if len(c)), default=0), width):
            m = [_members(c, r, len(n), first, width) for c, r, n in zip(codes, rows, sizes, strict=False)]
            both += m[0] @ m[-1].T
        # a bound first, so that exact divisions are made only for pairs near or over the bar
        a, b = np.nonzero(both >= np.maximum(1, least * (sizes[0][:, None] + sizes[-1][None, :]) / (1 + least) - 1e-3))
        one, two, n = owners[0][a], owners[-1][b], both[a, b].astype(np.int64)
        share = n / (sizes[0][a] + sizes[-1][b] - n)
        good = (share >= least) & ((one < two) if i == j else True)
        one, two = one[good], two[good]
        return pd.DataFrame({"one": np.minimum(one, two), "two": np.maximum(one, two), "jaccard": share[good]})

    return of


def jaccard_pairs(sets: DataFrame, least: float, block: int = BLOCK, width: int = ITEMS) -> DataFrame:
    """one, two, jaccard: pairs of owners, one < two, whose distinct items have a Jaccard of `least` (over 0) or more. sets: owner (a number), item.

    Owners fall into blocks by hash, and each pair of blocks is compared at once. No pair of owners is dealt out or kept but those in the result; what is dealt grows
    with owners times blocks. The comparisons, and what the data make of the result, are quadratic.
    """
    held = sets.filter("owner is not null and item is not null").select("owner", "item").distinct()
    codes = held.select("item").distinct().withColumn("code", F.row_number().over(Window.orderBy("item")))  # a row for each item
    packed = held.join(codes, "item").groupBy("owner").agg(F.collect_list("code").alias("items"))
    blocks = max(1, -(-sets.agg(F.count_distinct("owner")).first()[0] // block))
    mine = packed.withColumn("block", F.pmod(F.xxhash64("owner"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = mine.withColumn("other", other).select("owner", "items", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    out = T.StructType([T.StructField("one", sets.schema["owner"].dataType), T.StructField("two", sets.schema["owner"].dataType), T.StructField("jaccard", T.DoubleType())])
    return copies.groupBy("i", "j").applyInPandas(_compare(least, width), out)
