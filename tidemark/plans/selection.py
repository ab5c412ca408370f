"""Queries: selection, grouping, profiles, names, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, segments, select, sequences
from ..session import table
from ..sources import views
from .registry import query


@query("WITH EV SELECT kind, count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(DISTINCT actor) AS actors FROM ev GROUP BY kind")
def select_group_kind(spark: SparkSession, sf: str) -> DataFrame:
    return select.group_events(views.events(spark, sf), F.col("kind"), "kind")


@query("WITH EV SELECT CAST(t // 86400 AS BIGINT) AS day, count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(DISTINCT actor) AS actors FROM ev GROUP BY 1")
def select_group_day(spark: SparkSession, sf: str) -> DataFrame:
    return select.group_events(views.events(spark, sf), F.floor(F.col("t") / 86400), "day")


@query("WITH EV SELECT channel, count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(DISTINCT actor) AS actors FROM ev GROUP BY channel")
def select_group_channel(spark: SparkSession, sf: str) -> DataFrame:
    return select.group_events(views.events(spark, sf), F.col("channel"), "channel")


@query("""WITH EV , hit AS (SELECT id, t, actor, channel FROM ev WHERE kind = 'click' AND t >= 1704672000 AND t < 1705276800)
SELECT id, t, actor, channel, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY t, id LIMIT 50""")
def select_events_window(spark: SparkSession, sf: str) -> DataFrame:
    e = select.select_events(select.window(views.events(spark, sf), 1704672000, 1705276800), kind="click")
    return select.first_rows(e.select("id", "t", "actor", "channel"), 50, "t", "id")


@query("WITH EV SELECT id, actor, t FROM ev WHERE channel = '7' AND value > 50")
def select_meta_field(spark: SparkSession, sf: str) -> DataFrame:
    return select.select_events(views.events(spark, sf), fields={"k": 7}).filter("value > 50").select("id", "actor", "t")


@query("""WITH EV , c AS (SELECT 'k' AS field, channel AS v, count(*) AS n FROM ev WHERE channel IS NOT NULL GROUP BY channel)
SELECT field, CAST(sum(n) AS BIGINT) AS n, count(*) AS distinct_values, CASE WHEN count(*) > 50 THEN '(many)' ELSE '' END AS top_values FROM c GROUP BY field""")
def meta_field_profile(spark: SparkSession, sf: str) -> DataFrame:
    return select.field_profile(views.events(spark, sf))


@query("""WITH EV , c AS (SELECT actor, channel, count(*) AS n FROM ev GROUP BY ALL)
SELECT actor, channel, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY actor ORDER BY n DESC, channel) AS INTEGER) AS place FROM c) WHERE place <= 5""")
def topk_channels_per_actor(spark: SparkSession, sf: str) -> DataFrame:
    return select.top_per_group(views.events(spark, sf), "actor", "channel", 5)


@query("SELECT doc_id AS id, source AS actor FROM documents WHERE regexp_matches(text, '(wor|sen)[a-z]+ess|license|copyright', 'is')")
def regex_grep(spark: SparkSession, sf: str) -> DataFrame:
    return select.grep(views.posts(spark, sf), ["(wor|sen)[a-z]+ess", "license", "copyright"]).select("id", "actor")


@query("SELECT source AS actor, count(*) AS n FROM documents WHERE contains(lower(text), 'license') GROUP BY source")
def substring_by_actor(spark: SparkSession, sf: str) -> DataFrame:
    return select.select_events(views.posts(spark, sf), contains="License").groupBy("actor").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT c_custkey AS id, CASE WHEN CAST(c_custkey AS VARCHAR) = 'customer#000000012' THEN 1 WHEN lower(c_name) = 'customer#000000012' THEN 2 WHEN contains(lower(c_name), 'customer#000000012') THEN 4 END AS how FROM customer)
SELECT id, CAST(how AS INTEGER) AS how FROM m WHERE how = (SELECT min(how) FROM m)""")
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    return select.resolve(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")), "Customer#000000012")


@query("""WITH n AS (SELECT s_suppkey AS id, lower(s_name) AS alias FROM supplier UNION SELECT s_suppkey, right(lower(s_name), 1) || 'x' FROM supplier UNION SELECT s_suppkey, right(s_name, 1) FROM supplier)
SELECT alias, min(id) AS id FROM (SELECT DISTINCT * FROM n WHERE length(alias) >= 2) GROUP BY alias HAVING count(*) = 1""")
def alias_map(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    names = F.array("s_name", F.concat(F.expr("right(s_name, 1)"), F.lit("X")), F.expr("right(s_name, 1)"))
    return select.aliases(s.select(F.col("s_suppkey").alias("id"), names.alias("names")))


@query("""SELECT doc_id AS id, CASE WHEN length(f) > 80 THEN rtrim(f[1:80]) || ' …' ELSE f END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)""")
def clip_texts(spark: SparkSession, sf: str) -> DataFrame:
    return views.posts(spark, sf).select("id", select.clip(F.col("text"), 80).alias("clipped"))


@query("""SELECT n_nationkey AS id, CASE WHEN r_name = n_name THEN n_name ELSE r_name || ' (' || n_name || ')' END AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def label_projection(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), select.role_label(F.col("r_name"), F.col("n_name")).alias("label"))


@query("""WITH EV , x AS (SELECT id, value, ['>', '>=', '<', '<=', '==', '!=', 'between', 'outside'][(id % 8 + 1)::INTEGER] AS op FROM ev)
SELECT op, count(*) AS n, count_if(CASE op WHEN '>' THEN value > 40 WHEN '>=' THEN value >= 40 WHEN '<' THEN value < 40 WHEN '<=' THEN value <= 40 WHEN '==' THEN value = 40 WHEN '!=' THEN value <> 40 WHEN 'between' THEN value BETWEEN 40 AND 60 ELSE NOT (value BETWEEN 40 AND 60) END) AS met FROM x GROUP BY op""", longs=("met",))
def expectations(spark: SparkSession, sf: str) -> DataFrame:
    ops = F.array(*map(F.lit, (">", ">=", "<", "<=", "==", "!=", "between", "outside")))
    e = views.events(spark, sf).withColumn("op", F.get(ops, (F.col("id") % 8).cast("int")))
    return e.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count_if(select.meets(F.col("op"), F.col("value"), F.lit(40), F.lit(60))).alias("met"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'high' ELSE 'medium' END AS confidence FROM labels)
SELECT doc_id FROM x WHERE confidence IN ('medium', 'high')""")
def confidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium")
    return table(spark, sf, "labels").filter(select.at_least(c, "medium")).select("doc_id")


@query("""WITH EV , x AS (SELECT DISTINCT actor FROM ev WHERE kind IN ('purchase', 'signup'))
SELECT kind, count(*) AS n FROM ev WHERE actor IN (SELECT actor FROM x) AND actor NOT IN (SELECT actor FROM ev WHERE value > 99.995) GROUP BY kind""")
def mapped_actors(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    doers, system = e.filter(F.col("kind").isin("purchase", "signup")).select("actor").distinct(), e.filter("value > 99.995").select("actor").distinct()
    return e.join(doers, "actor", "left_semi").join(system, "actor", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH EV , k AS (SELECT channel, count(*) AS c FROM ev GROUP BY channel HAVING count(*) > 0.011 * (SELECT count(*) FROM ev))
SELECT kind, count(*) AS n FROM ev WHERE channel NOT IN (SELECT channel FROM k) GROUP BY kind""")
def pervasive_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    total = e.agg(F.count(F.lit(1)).alias("N"))
    common = e.groupBy("channel").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(total)).filter("c > 0.011 * N").select("channel")
    return e.join(common, "channel", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("WITH EV SELECT id FROM ev ORDER BY md5('5|' || id::VARCHAR), id LIMIT 200")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return e.orderBy(select.hash_order("5", F.col("id")), "id").limit(200).select("id")


@query("""WITH EV SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind, t // 86400 ORDER BY md5('7|' || id::VARCHAR), id) AS r FROM ev) WHERE r <= 3""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("h", select.hash_order("7", F.col("id")))
    w = Window.partitionBy("kind", "day").orderBy("h", "id")
    return e.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("id", "kind")


@query("WITH EV SELECT ('0x' || substr(md5(actor::VARCHAR), 1, 2))::BIGINT % 2 AS half, count(*) AS n, count(DISTINCT actor) AS actors FROM ev GROUP BY 1")
def hash_halves(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return e.groupBy(select.hash_half(F.col("actor")).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))


@query("""WITH EV , x AS (SELECT id, row_number() OVER (ORDER BY t, id) - 1 AS i, count(*) OVER () AS n FROM ev WHERE kind = 'signup')
SELECT id FROM x WHERE n <= 20 OR i IN (SELECT CAST(floor(j * (n - 1) / 19) AS BIGINT) FROM range(20) r(j))""")
def even_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return select.thin(views.events(spark, sf).filter("kind = 'signup'").select("id", "t"), 20, "t", "id").select("id")


@query("""WITH EV SELECT id, actor FROM (SELECT id, actor, row_number() OVER (PARTITION BY actor ORDER BY value DESC, id) AS rn FROM ev) ORDER BY rn, actor, id LIMIT 100""")
def quota_ranking(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("actor").orderBy(F.desc("value"), "id")
    return views.events(spark, sf).withColumn("rn", F.row_number().over(w)).orderBy("rn", "actor", "id").limit(100).select("id", "actor")


@query("WITH EV SELECT id, t FROM ev WHERE kind = 'error' ORDER BY t, id LIMIT 25 OFFSET 50")
def paged_events(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).filter("kind = 'error'").orderBy("t", "id").offset(50).limit(25).select("id", "t")


@query("""WITH EV , s AS (SELECT DISTINCT (t - 345600) // 604800 * 604800 + 345600 AS start_t FROM ev), d AS (SELECT DISTINCT t // 86400 * 86400 AS start_t FROM ev), span AS (SELECT max(t) - min(t) AS x, min(t) AS low FROM ev),
c AS (SELECT CASE WHEN x > 60 * 86400 THEN 1 ELSE 0 END AS weekly, low FROM span)
SELECT CAST(CASE WHEN weekly = 1 THEN (start_t - 345600) // 604800 - (low - 345600) // 604800 ELSE start_t // 86400 - low // 86400 END AS BIGINT) AS segment_id, CAST(start_t AS BIGINT) AS start_t
FROM (SELECT *, 1 AS w FROM s UNION ALL SELECT *, 0 FROM d), c WHERE w = weekly""")
def segments_auto(spark: SparkSession, sf: str) -> DataFrame:
    return segments.automatic(views.events(spark, sf))


@query("""WITH EV , ph(segment_id, start_t) AS (VALUES (0, 1704240000), (1, 1704844800), (2, 1705881600))
SELECT segment_id, count(*) AS n, count(DISTINCT actor) AS actors FROM (SELECT ev.*, coalesce((SELECT arg_max(p.segment_id, p.start_t) FROM ph p WHERE p.start_t <= ev.t), 0) AS segment_id FROM ev) GROUP BY segment_id""")
def segments_phases(spark: SparkSession, sf: str) -> DataFrame:
    phases = spark.createDataFrame([(0, 1704240000), (1, 1704844800), (2, 1705881600)], "segment_id int, start_t long")
    e = segments.assign(views.events(spark, sf), phases)
    return e.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))


@query("""WITH EV , o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS r FROM ev), f AS (SELECT * FROM o)
SELECT f.id AS focus, o.id, CAST(o.r - f.r AS INTEGER) AS "offset" FROM f JOIN o ON o.channel = f.channel AND abs(o.r - f.r) <= 3""")
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return sequences.context(e, "channel", e.select("id"), 3)


@query("WITH EV SELECT kind, channel, count(*) AS n, count(DISTINCT actor) AS actors FROM ev GROUP BY ROLLUP (kind, channel)")
def rollup_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.zoom(views.events(spark, sf), "kind", "channel")


@query("WITH EV SELECT actor, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ev GROUP BY actor")
def concatenated_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).groupBy("actor").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("WITH EV SELECT kind, actor, t AS first_t, id FROM (SELECT *, row_number() OVER (PARTITION BY kind, actor ORDER BY t, id) AS r FROM ev) WHERE r = 1")
def first_adopters(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).groupBy("kind", "actor").agg(F.min(F.struct("t", "id")).alias("f")).select("kind", "actor", F.col("f.t").alias("first_t"), F.col("f.id").alias("id"))


@query("""WITH EV SELECT strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%G-W%V') AS week, count(*) AS n FROM ev GROUP BY 1""")
def iso_weeks(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import iso_week

    return views.events(spark, sf).groupBy(iso_week(F.timestamp_seconds("t")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
