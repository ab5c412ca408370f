"""The driver tables seen as canonical events, relations, texts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, actor, kind, channel, value, meta, t (whole epoch seconds)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("channel"),
        "value", F.col("props").alias("meta"), F.unix_timestamp("ts").alias("t"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations customer -> supplier: src, dst, t, event_id."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.unix_timestamp("l_shipdate").alias("t"), F.col("o_orderkey").alias("event_id"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as events: id, actor (source), channel (language), text; in order of id."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("actor"), F.col("lang").alias("channel"), "text")
