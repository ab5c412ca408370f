"""Typed relations between actors, replies, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import asof_forward

METHODS = ("to_field", "reply_field", "mention", "llm_text")


def with_reply_to(events: DataFrame, place: str = "channel") -> DataFrame:
    """events with reply_to: the previous event of the place, if another actor's."""
    w = Window.partitionBy(place).orderBy("t", "id")
    return events.withColumn("reply_to", F.when(F.lag("actor").over(w) != F.col("actor"), F.lag("id").over(w)))


def reply_edges(events: DataFrame) -> DataFrame:
    """addressed relations from reply_to: src, dst, t, event_id; self-edges and unknown parents are dropped."""
    parent = events.select(F.col("id").alias("pid"), F.col("actor").alias("dst"))
    return events.join(parent, F.col("reply_to") == F.col("pid")).filter(F.col("actor") != F.col("dst")).select(F.col("actor").alias("src"), "dst", "t", F.col("id").alias("event_id"))


def mention_edges(events: DataFrame, aliases: DataFrame, text_col: str = "text") -> DataFrame:
    """addressed relations from @names: src, dst, t, event_id. The longest alias wins; a word character or a dot with a digit must not follow.

    aliases (alias, id) is one row per known name. Texts are cut at every @; each piece is compared with the aliases of its first letters.
    """
    pieces = events.filter(F.contains(text_col, F.lit("@"))).select("id", "actor", "t", F.explode(F.slice(F.split(F.lower(text_col), "@"), 2, 10**6)).alias("p")).filter("p <> ''")
    named = aliases.select("alias", F.col("id").alias("dst"), F.substring("alias", 1, 2).alias("h"))
    joined = pieces.withColumn("h", F.substring("p", 1, 2)).join(named, "h").filter(F.startswith("p", "alias"))
    rest = F.expr("substring(p, length(alias) + 1)")
    ok = joined.filter(~rest.rlike(r"^(\w|\.\d)"))
    best = ok.groupBy("id", "actor", "t", "p").agg(F.max_by("dst", F.length("alias")).alias("dst"))
    return best.filter(F.col("actor") != F.col("dst")).select(F.col("actor").alias("src"), "dst", "t", F.col("id").alias("event_id")).distinct()


def first_method(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of (method, edges): for each event and addressee the first method of the list stays."""
    rows = None
    for rank, (method, edges) in enumerate(sources):
        one = edges.select("src", "dst", "t", "event_id", F.lit(method).alias("method"), F.lit(rank).alias("_rank"))
        rows = one if rows is None else rows.union(one)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("event_id", "dst").orderBy("_rank"))).filter("_r = 1").drop("_r", "_rank")


def answered(edges: DataFrame, tolerance: int) -> DataFrame:
    """edges with r_t and r_id: the first event by which dst addressed src, later than the edge, within tolerance seconds."""
    one = edges.select(F.col("src").alias("k1"), F.col("dst").alias("k2"), "t", "event_id")
    two = edges.select(F.col("dst").alias("k1"), F.col("src").alias("k2"), "t", F.col("event_id").alias("id"))
    return asof_forward(one, two, ["k1", "k2"], tolerance).select(F.col("k1").alias("src"), F.col("k2").alias("dst"), "t", "event_id", "r_t", "r_id")


def replied(answers: DataFrame) -> DataFrame:
    """One row for each reply event and pair."""
    return answers.filter("r_id is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("r_id").alias("event_id"), F.col("r_t").alias("t")).distinct()


def reciprocity(edges: DataFrame) -> DataFrame:
    """For each unordered pair with edges: a < b, a_to_b, b_to_a, and the smaller over the larger."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    out = edges.groupBy(a.alias("a"), b.alias("b")).agg(F.count_if(F.col("src") == a).alias("a_to_b"), F.count_if(F.col("src") != a).alias("b_to_a"))
    return out.withColumn("reciprocity", F.least("a_to_b", "b_to_a") / F.greatest("a_to_b", "b_to_a"))


def nodes(events: DataFrame, edges: DataFrame, answers: DataFrame, segment: Column, top: int = 5) -> DataFrame:
    """Actor by segment: first, last, n, out, in, answered share of what was addressed to it, top peers."""
    own = events.groupBy("actor", segment.alias("segment")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))
    out = edges.groupBy(F.col("src").alias("actor"), segment.alias("segment")).agg(F.count(F.lit(1)).alias("n_out"))
    into = answers.groupBy(F.col("dst").alias("actor"), segment.alias("segment")).agg(F.count(F.lit(1)).alias("n_in"), F.count("r_id").alias("answered"))
    both = edges.select(F.col("src").alias("actor"), F.col("dst").alias("peer"), "t").union(edges.select("dst", "src", "t"))
    counts = both.groupBy("actor", segment.alias("segment"), "peer").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("actor", "segment").orderBy(F.desc("c"), "peer")
    peers = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("actor", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "peer"))), lambda x: x["peer"].cast("string")), ",").alias("peers"))
    keys = ["actor", "segment"]
    all_ = own.join(out, keys, "left").join(into, keys, "left").join(peers, keys, "left").na.fill(0, ["n_out", "n_in", "answered"])
    return all_.withColumn("answered_share", F.when(F.col("n_in") > 0, F.col("answered") / F.col("n_in")))


def shipped(orders: DataFrame, lines: DataFrame, parts: int, least: int = 3) -> DataFrame:
    """src (customer) -> dst (supplier): n lines, orders, first_t; at least `least` lines.

    Lines are added up by order and supplier before they meet their order, so orders are counted without keeping them apart. `parts` should grow with the lines,
    so that a task's share doesn't.
    """
    own = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k"), F.min(F.unix_timestamp("l_shipdate")).alias("t"))
    o = orders.repartition(parts, "o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("m"))
    joined = own.join(o.hint("merge"), own.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), "k", "m", "t")
    out = joined.repartition(parts, "src", "dst").groupBy("src", "dst").agg(F.sum(F.col("k") * F.col("m")).alias("n"), F.count(F.lit(1)).alias("orders"), F.min("t").alias("first_t"))
    return out.filter(F.col("n") >= least)
