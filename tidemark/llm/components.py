"""Connected components of links between ids, by alternating large and small stars.

All steps are joins and partial minima over the edge table; nothing is gathered per node or on the driver. Each round is
cut to the shared checkpoint folder. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct u > v. Links each node's larger (or smaller) neighbours to its least one."""
    down = edges.select(F.col("u").alias("n"), F.col("v").alias("x"))
    around = down.union(edges.select(F.col("v").alias("n"), F.col("u").alias("x"))) if large else down
    least = around.groupBy("n").agg(F.min("x").alias("least")).select("n", F.least("n", "least").alias("m"))
    joined = around.join(least, "n")
    if large:
        out = joined.filter("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("x").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id in a link with another: component_id is the least id reachable, itself included.

    Null ends, loops and repeated links don't count; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a <> b")
    current = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(current)
    while state[0]:
        current = cut(_stars(_stars(current, True), False))
        new = _state(current)
        if new == state:
            break
        state = new
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
