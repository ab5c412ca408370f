"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share a total of words; none may exceed a number of
epochs of its source, and the excess is shared again by weight. A source gives its complete epochs first: every document as
often as fits. The rest is filled from its documents by ascending exponential key, -ln(u) / quality weight, until the sum of
sizes comes nearest to the budget; u is a hash of id and text, so reruns agree.

Nothing sorts a source: its keys are cut at measured quantiles into PARTS ranges, whose sums are added up, and the range that holds
the edge is cut again until it has BUCKET keys at most; only these are ordered. Equal keys, those of equal rows, are one key with a number of
rows. Texts are scanned once for a small row each; the result is a threshold for each source, applied without moving texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .kernels import chunks, int64, words

SYMBOL = np.zeros(256, bool)
SYMBOL[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
BUCKET = 2000
PARTS = 64
WEIGHTS = (3, 1, 2)


def measure(texts: pa.Array) -> pa.Array:
    """The number of words of each text, and its quality weight: from 0.05 to 1, the share of code points other than ASCII symbols."""
    size, weight = np.zeros(len(texts), np.int64), np.ones(len(texts))
    for i, j, data, offsets in chunks(texts):
        starts, _, owner = words(data, offsets)
        size[i:j] = np.bincount(owner, minlength=j - i)
        whole, marks = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in ((data & 0xC0) != 0x80, SYMBOL[data]))
        weight[i:j] = np.maximum(0.05, 1 - marks / np.maximum(whole, 1))
    return pa.StructArray.from_arrays([int64(size), pa.array(weight)], names=["size", "weight"])


def _uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1): 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def keyed(documents: DataFrame, id_col: str, source_col: str, text_col: str, weight: Column | None = None, seed: int = 17, *more: Column) -> DataFrame:
    """id, source, size and es, the exponential key, of each document."""
    text = F.col(text_col)
    u = _uniform(seed, F.col(id_col).cast("long"), text)
    given = F.lit(None).cast("double") if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.arrow_udf(measure, "struct<size:bigint,weight:double>")(text).alias("m"), u.alias("u"), given.alias("w"), *more)
    named = [c for c in rows.columns if c not in ("id", "source", "m", "u", "w")]
    return rows.select("id", "source", F.col("m.size").alias("size"), (-F.log("u") / F.coalesce("w", "m.weight")).alias("es"), *named)


def targets(sizes: DataFrame, share: float, epochs: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from one row per source: (source, source_size).

    Sources in order of epochs * size / weight run full one after the other: with the first k full, the others share what is
    left by weight, and k is right as soon as the next one has room for its share. The table has a row for each source.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(epochs))
    order = W.orderBy((cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = weighed.select("source", "source_size", "w", cap.alias("cap"), F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("full"), (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"), (F.sum("source_size").over(whole) * F.lit(float(share))).alias("total"))
    level = level.withColumn("rate", (F.col("total") - F.col("full")) / F.col("open"))
    level = level.withColumn("rate", F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("rate")))).over(whole)[F.lit("rate")])
    return level.select("source", "source_size", F.round(F.least("cap", F.coalesce(F.col("rate") * F.col("w"), F.col("cap"))), 6).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(rows: DataFrame, share: float, epochs: float) -> DataFrame:
    """One row per source with words: source, source_size, target, rounds (complete epochs), edge (the last key of the fraction, null: none),
    open (the edge itself is left out), copies (how many rows of the edge's key are taken), all_copies (whether that is all of them).

    rows: id, source, size, es. Every source has its place in the order of weights, with words or without.
    """
    stats = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = targets(stats, share, epochs).filter("source_size > 0")
    goal = cut(goal.withColumn("rounds", F.floor(F.col("target") / F.col("source_size")).cast("long")).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")))
    keys = rows.filter("size > 0").groupBy("source", "es").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    live = keys.join(goal.select(F.col("source").alias("s2"), "budget"), _same("source", "s2")).drop("s2").withColumn("base", F.lit(0.0)).filter("budget > 0")
    live = cut(live)
    while live.groupBy("source").count().filter(F.col("count") > BUCKET).take(1):
        # PARTS ranges of about as many keys; the window orders one row for each range of a source
        cuts = live.groupBy(F.col("source").alias("s2")).agg(F.percentile_approx("es", [k / PARTS for k in range(1, PARTS)], 100 * PARTS).alias("cuts"))
        ranged = live.join(cuts, _same("source", "s2")).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("es")))).drop("s2", "cuts")
        sums = ranged.groupBy("source", "part", "base", "budget").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(W.partitionBy("source").orderBy("part")))
        edges = sums.filter((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget")))
        edges = edges.select(F.col("source").alias("s3"), F.col("part").alias("p3"), (F.col("upto") - F.col("words")).cast("double").alias("b3"))
        live = cut(ranged.join(edges, _same("source", "s3") & (F.col("part") == F.col("p3"))).select("source", "es", "size", "n", "budget", F.col("b3").alias("base")))
    placed = live.withColumn("start", F.col("base") + F.sum("size").over(W.partitionBy("source").orderBy("es")) - F.col("size"))
    fits = F.least(F.col("n"), F.floor((F.col("budget") - F.col("start")) / (F.col("size") / F.col("n")) + F.lit(0.5)).cast("long"))
    last = placed.withColumn("copies", fits).groupBy("source").agg(F.max(F.when(F.col("copies") >= 1, F.struct("es", "copies", "n"))).alias("last"), F.min("es").alias("low"))
    last = last.select(F.col("source").alias("s4"), F.coalesce("last.es", "low").alias("edge"), F.col("last").isNull().alias("open"), F.col("last.copies").alias("copies"), (F.col("last.copies") == F.col("last.n")).alias("all_copies"))
    out = goal.join(last, _same("source", "s4"), "left")
    return cut(out.select("source", "source_size", "target", "rounds", "edge", F.coalesce("open", F.lit(False)).alias("open"), "copies", F.coalesce("all_copies", F.lit(True)).alias("all_copies")))


def _times(rows: DataFrame, chosen: DataFrame, epochs: float, order: list[str]) -> DataFrame:
    """rows with their source's size and target, and times, how often each is taken. chosen is the plan, a row for each source.

    Rows that share the key of an edge that takes some of them only, equal in id and text, are taken in the order given.
    """
    out = rows.join(chosen.withColumnRenamed("source", "s2"), _same("source", "s2"), "left").drop("s2")
    tied = F.coalesce(~F.col("all_copies") & ~F.col("open") & (F.col("es") == F.col("edge")) & (F.col("size") > 0), F.lit(False))
    extra = F.when(F.col("open"), F.col("es") < F.col("edge")).otherwise(F.col("es") <= F.col("edge"))
    if chosen.filter("not all_copies and not open").take(1):
        ties = out.filter(tied).withColumn("taken_too", F.row_number().over(W.partitionBy("source", "es").orderBy(*order)) <= F.col("copies"))
        out = out.filter(~tied).withColumn("taken_too", extra).unionByName(ties)
    else:
        out = out.withColumn("taken_too", extra)
    times = F.when(F.col("size") == 0, 0).otherwise(F.coalesce("rounds", F.lit(0)) + F.coalesce(F.col("taken_too").cast("int"), F.lit(0)))
    return out.withColumn("times", F.least(times, F.lit(int(epochs))).cast("long"))


def repeat(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, epochs: float = 2, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """The rows of documents, all columns as they are, each as often as mix takes it."""
    rows = keyed(documents, id_col, source_col, text_col, weight, seed, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    chosen = plan(cut(rows.select("id", "source", "size", "es")), share, epochs)
    return _times(rows.withColumn("hash", F.xxhash64("row")), chosen, epochs, ["hash"]).select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, epochs: float = 2, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """One row per row of documents: the id, source, size, source_size, target, times (how often it is taken), taken (times * size).

    size is the number of words of the whole text. Documents are taken whole, so a source comes within half a document of its
    target. Documents without words, null texts included, have size 0 and are never taken; a source with only such ones
    has size and target 0, and its place in the order of weights. A null source is a source of its own, the last. The id may be null or
    repeated: of rows with one id and text as many are taken as fit. An empty table gives an empty result.
    """
    rows = cut(keyed(documents, id_col, source_col, text_col, weight, seed))
    out = _times(rows, plan(rows, share, epochs), epochs, ["id"])
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.coalesce("source_size", F.lit(0)).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), "times", (F.col("times") * F.col("size")).alias("taken"),
    )
