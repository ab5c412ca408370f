"""Queries: boards, links, incidents, evidence and evaluation, as compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, overlap, relations, sequences
from ..session import table
from ..sources import views
from .measures import R6
from .registry import query
from .sequence import REPLIES


@query("""WITH EV , g AS (SELECT t // 604800 AS w, kind, count(*) AS k FROM ev GROUP BY ALL), j AS (SELECT *, sum(k) OVER (PARTITION BY w) AS n, sum(k) OVER (PARTITION BY kind) AS kk, sum(k) OVER () AS nn FROM g)
SELECT w, kind, k, round(k / n, 6) AS share, round((kk - k) / (nn - n), 6) AS base FROM j WHERE n >= 50 AND k >= 15 AND k / n >= greatest(2.0 * (kk - k) / (nn - n), (kk - k) / (nn - n) + 0.2)""")
def period_shift_board(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumn("w", F.floor(F.col("t") / 604800))
    out = metrics.outliers(e, "kind", "w", 50).filter("k >= 15")
    return R6(out.select("w", "kind", "k", "share", "base"), "share", "base")


@query(f"""WITH EV , {REPLIES}, x AS (SELECT src, dst, event_id, 2 AS rank, 'addressed' AS type FROM ad UNION ALL SELECT src, dst, event_id, 1, 'replied' FROM ad WHERE event_id % 5 = 0 UNION ALL SELECT src, dst, event_id, 0, 'corrected' FROM ad WHERE event_id % 11 = 0)
SELECT src, dst, event_id, arg_min(type, rank) AS type FROM x GROUP BY ALL""")
def strongest_links(spark: SparkSession, sf: str) -> DataFrame:
    e = relations.reply_edges(relations.with_reply_to(views.events(spark, sf)))
    rank = lambda df, r, t: df.select("src", "dst", "event_id", F.lit(r).alias("rank"), F.lit(t).alias("type"))
    x = rank(e, 2, "addressed").union(rank(e.filter("event_id % 5 = 0"), 1, "replied")).union(rank(e.filter("event_id % 11 = 0"), 0, "corrected"))
    return x.groupBy("src", "dst", "event_id").agg(F.min_by("type", "rank").alias("type"))


@query("""WITH c AS (SELECT source AS actor, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT actor, sum(n) AS v FROM c GROUP BY actor), r AS (SELECT actor, v, row_number() OVER (ORDER BY v, actor) AS i, count(*) OVER () AS m, sum(v) OVER () AS s FROM t)
SELECT round(2 * sum(i * v) / (max(m) * max(s)) - (max(m) + 1) / max(m), 6) AS gini, count(*) AS actors FROM r""")
def gini_concentration(spark: SparkSession, sf: str) -> DataFrame:
    v = views.posts(spark, sf).groupBy("actor").agg(F.count(F.lit(1)).alias("v"))
    r = v.withColumn("i", F.row_number().over(Window.orderBy("v", "actor")))
    m = F.count(F.lit(1))
    return R6(r.agg((2 * F.sum(F.col("i") * F.col("v")) / (m * F.sum("v")) - (m + 1) / m).alias("gini"), m.alias("actors")), "gini")


@query("""WITH EV , a AS (SELECT id, channel, t, value > 90 AS b FROM ev), x AS (SELECT a.channel, a.id, count(o.id) AS near FROM a LEFT JOIN a o ON o.channel = a.channel AND o.b AND o.t > a.t AND o.t <= a.t + 86400 WHERE a.b GROUP BY ALL)
SELECT CASE WHEN near = 0 THEN 'none' WHEN near = 1 THEN 'one' ELSE 'more' END AS bin, count(*) AS n FROM x GROUP BY 1""")
def echo_bins(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).filter("value > 90").select("id", "channel", "t")
    w = Window.partitionBy("channel").orderBy("t").rangeBetween(1, 86400)
    near = F.count(F.lit(1)).over(w)
    return e.withColumn("near", near).groupBy(F.when(F.col("near") == 0, "none").when(F.col("near") == 1, "one").otherwise("more").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH EV , f AS (SELECT actor, kind, id, t, row_number() OVER (PARTITION BY actor, kind ORDER BY t, id) AS r FROM ev) SELECT kind, count_if(r = 1) AS first_reads, count_if(r > 1) AS re_reads FROM f GROUP BY kind""", longs=("first_reads", "re_reads"))
def first_and_repeat(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    first = sequences.first_per(e, ["actor", "kind"], "t", "id").groupBy("kind").agg(F.count(F.lit(1)).alias("first_reads"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(first, "kind").select("kind", "first_reads", (F.col("n") - F.col("first_reads")).alias("re_reads"))


@query("""SELECT l.quality, count(*) AS n, count_if(abs(d.n_chars - length(d.text)) <= 0.01 * length(d.text) + 1e-9) AS within FROM documents d JOIN labels l USING (doc_id) GROUP BY l.quality""", longs=("within",))
def numeric_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    ok = F.abs(F.col("n_chars") - F.length("text")) <= 0.01 * F.length("text") + 1e-9
    return d.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("within"))


@query("""WITH EV , p AS (SELECT a.actor AS one, b.actor AS two, count(*) AS shared FROM (SELECT DISTINCT actor, channel FROM ev WHERE kind = 'purchase') a JOIN (SELECT DISTINCT actor, channel FROM ev WHERE kind = 'purchase') b ON a.channel = b.channel AND a.actor < b.actor GROUP BY 1, 2), s AS (SELECT actor, count(DISTINCT channel) AS c FROM ev WHERE kind = 'purchase' GROUP BY actor)
SELECT one, two, round(shared / (x.c + y.c - shared), 6) AS jaccard FROM p JOIN s x ON x.actor = one JOIN s y ON y.actor = two WHERE shared / (x.c + y.c - shared) >= 0.2""")
def actor_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).filter("kind = 'purchase'").select(F.col("actor").alias("owner"), F.col("channel").alias("item"))
    return R6(overlap.jaccard_pairs(e, 0.2), "jaccard")


@query(f"""WITH RECURSIVE EV , {REPLIES}, c AS (SELECT id, reply_to, id AS place, 0 AS hops FROM r UNION ALL SELECT c.id, r.reply_to, r.id, hops + 1 FROM c JOIN r ON r.id = c.reply_to WHERE hops < 4) SELECT id, arg_max(place, hops) AS root, CAST(max(hops) AS INTEGER) AS hops FROM c GROUP BY id""")
def pointer_chase(spark: SparkSession, sf: str) -> DataFrame:
    e = relations.with_reply_to(views.events(spark, sf)).select("id", "reply_to")
    out = e.select("id", F.col("id").alias("root"), F.col("reply_to").alias("next"), F.lit(0).alias("hops"))
    for _ in range(4):
        step = e.select(F.col("id").alias("_i"), F.col("reply_to").alias("_n"))
        joined = out.join(step, F.col("next") == F.col("_i"), "left")
        found = F.col("_i").isNotNull()
        out = joined.select("id", F.when(found, F.col("_i")).otherwise(F.col("root")).alias("root"), F.when(found, F.col("_n")).alias("next"), (F.col("hops") + found.cast("int")).alias("hops"))
    return out.select("id", "root", "hops")


@query("""WITH EV , x AS (SELECT actor, kind, value, row_number() OVER (PARTITION BY actor ORDER BY value DESC, id) AS r FROM ev) SELECT actor, string_agg(kind, '>' ORDER BY r) AS top FROM x WHERE r <= 3 GROUP BY actor""")
def actor_cards(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("actor").orderBy(F.desc("value"), "id")
    x = views.events(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return x.groupBy("actor").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "kind"))), lambda s: s["kind"]), ">").alias("top"))


@query("""WITH EV , c AS (SELECT t // 86400 AS day, kind, count(*) AS n FROM ev GROUP BY ALL), d AS (SELECT day FROM c GROUP BY day HAVING sum(n) >= 5), o AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM d),
x AS (SELECT o.day, sum(a.n * b.n) AS dot FROM o JOIN c a ON a.day = o.day JOIN c b ON b.day = o.before AND b.kind = a.kind GROUP BY o.day), l AS (SELECT day, sqrt(sum(n * n)) AS size FROM c GROUP BY day)
SELECT o.day, round(1 - coalesce(dot, 0) / (p.size * q.size), 6) AS distance FROM o JOIN l p ON p.day = o.day JOIN l q ON q.day = o.before LEFT JOIN x ON x.day = o.day""")
def mix_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine distance of each day's mix of activity from the day before it that has 5 events or more, as it has itself."""
    c = views.events(spark, sf).groupBy(F.floor(F.col("t") / 86400).alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    days = c.groupBy("day").agg(F.sum("n").alias("total"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size")).filter("total >= 5")
    w = Window.orderBy("day")  # a row for each day
    order = days.select("day", "size", F.lag("day").over(w).alias("before"), F.lag("size").over(w).alias("size_before")).filter("before is not null")
    dot = order.join(c, "day").join(c.select(F.col("day").alias("before"), "kind", F.col("n").alias("m")), ["before", "kind"]).groupBy("day").agg(F.sum(F.col("n") * F.col("m")).alias("both"))
    out = order.join(dot, "day", "left").select("day", (1 - F.coalesce("both", F.lit(0)) / (F.col("size") * F.col("size_before"))).alias("distance"))
    return R6(out, "distance")


@query("""WITH EV , x AS (SELECT kind, ntile(4) OVER (PARTITION BY kind ORDER BY t, id) AS q, value FROM ev) SELECT kind, CAST(q AS INTEGER) AS q, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL""")
def quartile_cells(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("kind").orderBy("t", "id")
    return views.events(spark, sf).withColumn("q", F.ntile(4).over(w)).groupBy("kind", "q").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH v AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS stratum FROM labels) SELECT stratum, count(*) AS n FROM v GROUP BY stratum""")
def gold_strata(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    return table(spark, sf, "labels").groupBy(s.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH EV , s AS (SELECT actor, id, t, sum(length(meta)) OVER (PARTITION BY actor ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS upto FROM ev) SELECT actor, id FROM s WHERE upto <= 200""")
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("actor").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return views.events(spark, sf).withColumn("upto", F.sum(F.length("meta")).over(w)).filter("upto <= 200").select("actor", "id")


@query("""WITH EV , p AS (SELECT DISTINCT actor FROM ev WHERE kind = 'purchase' AND value > 95), q AS (SELECT DISTINCT actor FROM ev WHERE kind = 'error' AND value > 95)
SELECT (SELECT count(*) FROM p) AS a, (SELECT count(*) FROM q) AS b, (SELECT count(*) FROM p JOIN q USING (actor)) AS both, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM q)) AS only_a""")
def set_cells(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).filter("value > 95")
    marks = e.groupBy("actor").agg(F.max((F.col("kind") == "purchase").cast("int")).alias("p"), F.max((F.col("kind") == "error").cast("int")).alias("q"))
    return marks.agg(F.sum("p").alias("a"), F.sum("q").alias("b"), F.sum(F.col("p") * F.col("q")).alias("both"), F.sum(F.col("p") * (1 - F.col("q"))).alias("only_a"))


@query("""SELECT c.c_mktsegment AS segment, r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer c ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2""")
def dimension_joins(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet").filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


