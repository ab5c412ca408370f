"""Queries: boards over labels, authority, behaviours and judgements, on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards, relations
from ..session import table
from ..sources import views
from .measures import R6
from .registry import query
from .sequence import REPLIES

#: Errors are concerns, by value of high, medium or low confidence; purchases over 90 are acts of authority on their channel.
FLAGS = "fl AS (SELECT id AS event_id, CASE WHEN value > 50 THEN 'error' ELSE 'minor' END AS kind, CASE WHEN value > 60 THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'low' END AS confidence, actor, channel, t FROM ev WHERE kind = 'error'), ac AS (SELECT channel, min(t) AS first_t FROM ev WHERE kind = 'purchase' AND value > 90 GROUP BY 1), fg AS (SELECT fl.*, coalesce(first_t < t, false) AS after FROM fl LEFT JOIN ac USING (channel) WHERE confidence <> 'low')"


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    kind = F.when(F.col("value") > 50, "error").otherwise("minor")
    confidence = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").otherwise("low")
    flags = e.filter("kind = 'error'").select(F.col("id").alias("event_id"), kind.alias("kind"), confidence.alias("confidence"), "actor", "channel", "t")
    return boards.after_authority(flags.filter("confidence <> 'low'"), e.filter("kind = 'purchase' and value > 90").select("channel", "t"), "channel")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return relations.reply_edges(relations.with_reply_to(views.events(spark, sf)))


@query(f"WITH EV , {FLAGS} SELECT id, actor, t FROM ev WHERE id IN (SELECT event_id FROM fg WHERE kind = 'error')")
def concern_events(spark: SparkSession, sf: str) -> DataFrame:
    return boards.with_label(views.events(spark, sf), _flags(spark, sf), concern="error").select("id", "actor", "t")


@query("SELECT c_custkey, c_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL")
def active_customers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    inside = (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return boards.active_in(table(spark, sf, "customer").select("c_custkey", "c_name"), o, "c_custkey", inside)


@query("""WITH l AS (SELECT doc_id, unnest([CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END]) AS label FROM labels), x AS (SELECT DISTINCT * FROM l WHERE label IS NOT NULL)
SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share_of_labels, round(count(*) / (SELECT count(DISTINCT doc_id) FROM x), 6) AS share_of_events FROM x GROUP BY label""")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.filter(F.array(F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return R6(boards.label_histogram(table(spark, sf, "labels").select("doc_id", marks.alias("marks")), "marks", "doc_id"), "share_of_labels", "share_of_events")


@query(f"WITH EV , {REPLIES} SELECT src, count(*) AS n, round(avg(CASE WHEN dst < 50 THEN 1 ELSE 0 END), 6) AS to_chosen, round(avg(CASE WHEN dst % 7 = src % 7 THEN 1 ELSE 0 END), 6) AS to_own_group FROM ad GROUP BY src")
def share_to_set(spark: SparkSession, sf: str) -> DataFrame:
    actors = views.events(spark, sf).select(F.col("actor").alias("id")).distinct().select("id", (F.col("id") % 7).alias("group"), (F.col("id") < 50).alias("chosen"))
    return R6(boards.share_to(_edges(spark, sf), actors), "to_chosen", "to_own_group")


@query(f"""WITH EV , {FLAGS}, d AS (SELECT kind, t // 86400 AS day, count(*) AS c FROM fg GROUP BY ALL), b AS (SELECT kind, day AS busiest_day FROM d QUALIFY row_number() OVER (PARTITION BY kind ORDER BY c DESC, day) = 1)
SELECT kind, count(DISTINCT event_id) AS events, count(DISTINCT actor) AS actors, count(DISTINCT channel) AS channels, count_if(confidence = 'high') AS high, count_if(after) AS after_authority, busiest_day FROM fg JOIN b USING (kind) GROUP BY kind, busiest_day""", longs=("high", "after_authority"))
def concern_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return boards.concern_patterns(_flags(spark, sf))


@query(f"""WITH EV , {FLAGS}, s AS (SELECT kind, count(DISTINCT event_id) / (SELECT count(*) FROM ev) AS share FROM fg GROUP BY kind), c AS (SELECT actor, kind, sum((CASE WHEN confidence = 'high' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) * (CASE WHEN after THEN 2 ELSE 1 END)) AS w, count(*) AS n, count_if(after) AS a FROM fg GROUP BY ALL)
SELECT actor, round(sum((CASE WHEN kind = 'error' THEN 4 ELSE 2 END) * least(1.0::DOUBLE, 0.05::DOUBLE / share) * log2(1 + w)), 6) AS score, sum(n) AS flags, sum(a) AS after_authority FROM c JOIN s USING (kind) GROUP BY actor""", longs=("flags", "after_authority"))
def concern_actors(spark: SparkSession, sf: str) -> DataFrame:
    severity = spark.createDataFrame([("error", boards.SEVERITY_WEIGHT["high"])], "kind string, weight int")
    return R6(boards.concern_score(_flags(spark, sf), table(spark, sf, "events").count(), severity), "score")


@query(f"WITH EV , {REPLIES}, a AS (SELECT src, dst, ad.t FROM ad JOIN ev ON ev.id = ad.event_id WHERE ev.value > 90), f AS (SELECT dst AS actor, min(t) AS first_t FROM a GROUP BY 1) SELECT (SELECT count(DISTINCT src) FROM a) AS removers, (SELECT count(DISTINCT dst) FROM a) AS targets, (SELECT count(DISTINCT actor) FROM ev JOIN f USING (actor) WHERE t > first_t) AS again")
def authority_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return boards.authority_summary(_edges(spark, sf).join(e.filter("value > 90").select(F.col("id").alias("event_id")), "event_id", "left_semi"), e)


CATEGORIES = "c AS (SELECT actor, id, t, unnest(list_filter([kind, CASE WHEN value > 50 THEN 'high' END, CASE WHEN kind = 'error' AND value > 80 THEN 'failed' END], lambda x: x IS NOT NULL)) AS category FROM ev)"


def _categories():
    marks = F.array("kind", F.when(F.col("value") > 50, "high"), F.when((F.col("kind") == "error") & (F.col("value") > 80), "failed"))
    return F.filter(marks, lambda x: x.isNotNull())


@query(f"WITH EV , {CATEGORIES}, r AS (SELECT *, t // 86400 AS bin, row_number() OVER (PARTITION BY actor, category, t // 86400 ORDER BY t, id) AS r FROM c) SELECT actor, category, bin, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY r) FILTER (r <= 40) AS ids FROM r GROUP BY ALL")
def behaviour_cube(spark: SparkSession, sf: str) -> DataFrame:
    return boards.behaviour_cube(views.events(spark, sf), _categories(), F.floor(F.col("t") / 86400))


@query("""WITH EV , d AS (SELECT actor, t // 86400 AS day, count(*) AS n FROM ev GROUP BY ALL), o AS (SELECT actor, count_if(n >= 2) AS active, sum(n) AS events FROM d GROUP BY actor), b AS (SELECT active, sum(events) AS events FROM o GROUP BY active), r AS (SELECT active, sum(events) OVER (ORDER BY active) AS upto, sum(events) OVER () AS total FROM b)
SELECT CAST(min(active) AS BIGINT) AS median_days, CASE WHEN min(active) >= 6 THEN 'day' ELSE 'hour' END AS grain FROM r WHERE upto * 2 >= total""")
def adaptive_grain(spark: SparkSession, sf: str) -> DataFrame:
    return boards.grain(views.events(spark, sf), least=2)


@query("WITH EV , c AS (SELECT channel, actor, count(*) AS c FROM ev GROUP BY ALL), o AS (SELECT channel, sum(c) AS n, max(c) AS most FROM c GROUP BY channel) SELECT channel, n, CASE WHEN most >= 0.05 * n THEN (SELECT min(actor) FROM c WHERE c.channel = o.channel AND c.c = o.most) END AS lead FROM o", longs=("n",))
def lead_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return boards.lead_profile(views.events(spark, sf), "channel", 0.05)


@query("WITH EV , d AS (SELECT t // 86400 * 86400 AS day, count(*) AS c FROM ev GROUP BY 1), b AS (SELECT day, c >= 0.034 * sum(c) OVER () AS busy FROM d) SELECT CASE WHEN busy THEN t // 10800 * 10800 ELSE day END AS bucket, count(*) AS n FROM ev JOIN b ON b.day = t // 86400 * 86400 GROUP BY 1")
def calendar_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return boards.calendar_buckets(views.events(spark, sf), 0.034)


@query("SELECT lang AS period, count(*) AS cases, count(l.doc_id) AS checked, round(count(l.doc_id) / count(*), 6) AS share, count(l.doc_id) / count(*) < 0.1 AS thin FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY lang")
def coverage_by_period(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("period"))
    return R6(boards.coverage(d, table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "period"), "share")


@query(f"""WITH EV , {REPLIES}, p AS (SELECT p.id AS a, r.id AS b FROM r JOIN ev p ON r.reply_to = p.id), m AS (SELECT id, actor, actor * 1000 + t // 86400 AS unit, min(t) OVER (PARTITION BY actor, t // 86400) AS start FROM ev)
SELECT DISTINCT y.unit AS v, x.unit AS u FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.unit <> y.unit AND x.actor <> y.actor AND x.start <= y.start""")
def unit_edges(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    e = views.events(spark, sf)
    day = F.floor(F.col("t") / 86400)
    members = e.select("id", (F.col("actor") * 1000 + day).alias("unit"), "actor", F.min("t").over(Window.partitionBy("actor", day)).alias("start"))
    pairs = relations.with_reply_to(e).filter("reply_to is not null").select(F.col("reply_to").alias("a"), F.col("id").alias("b"))
    return boards.edge_lift(pairs, members)


@query("WITH EV , x AS (SELECT s.id, m.id AS maker_id, row_number() OVER (PARTITION BY s.id ORDER BY m.t DESC, m.id DESC) AS r FROM ev s JOIN ev m ON m.channel = s.channel AND m.kind = 'signup' AND m.t < s.t AND m.t >= s.t - 259200 WHERE s.kind = 'purchase') SELECT id, maker_id, CAST(r AS INTEGER) AS place FROM x WHERE r <= 2")
def latest_makers(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumnRenamed("channel", "artifact")
    return boards.latest_makers(e.filter("kind = 'purchase'").select("id", "artifact", "t"), e.filter("kind = 'signup'").select(F.col("id").alias("maker_id"), "artifact", "t"))


@query("""WITH EV , p AS (SELECT channel, kind, id, row_number() OVER w AS i, row_number() OVER (PARTITION BY channel, kind ORDER BY t, id) AS nth, list(kind) OVER (PARTITION BY channel ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS near FROM ev WINDOW w AS (PARTITION BY channel ORDER BY t, id))
SELECT channel, kind, id, round(len(list_filter(near, lambda x: x = kind)) / len(near), 6) AS share FROM p WHERE nth = 1 AND i > 2 AND len(list_filter(near, lambda x: x = kind)) / len(near) >= 0.3""")
def first_changes(spark: SparkSession, sf: str) -> DataFrame:
    return R6(boards.first_changes(views.events(spark, sf), ["channel"], "kind", skip=2), "share")


@query("""WITH EV , r AS (SELECT channel, id, kind, t, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS i, count(*) OVER (PARTITION BY channel) AS n FROM ev), g AS (SELECT a.channel, a.id, k.kind, count_if(b.i < a.i) AS p, count_if(b.i >= a.i) AS q FROM r a JOIN (SELECT DISTINCT kind FROM ev) k ON true LEFT JOIN r b ON b.channel = a.channel AND b.kind = k.kind AND b.i >= a.i - 6 AND b.i < a.i + 6 WHERE a.i > 6 AND a.i + 5 <= a.n GROUP BY ALL)
SELECT channel, id, round(sum(abs(p - q)) / 12.0, 6) AS distance FROM g GROUP BY ALL""")
def mix_changes(spark: SparkSession, sf: str) -> DataFrame:
    return R6(boards.mix_changes(views.events(spark, sf), ["channel"], "kind", 6), "distance")


@query("""WITH EV , a AS (SELECT actor, day, row_number() OVER (PARTITION BY actor ORDER BY day) AS nth, count(*) OVER (PARTITION BY actor) AS total FROM (SELECT DISTINCT actor, t // 86400 AS day FROM ev)), u AS (SELECT DISTINCT actor, kind, t // 86400 AS day FROM ev)
SELECT actor, kind, count(*) AS used_days, min(nth) - 1 >= 5 AS new, max(total) - max(nth) >= 5 AS stopped FROM u JOIN a USING (actor, day) GROUP BY ALL""")
def started_and_stopped(spark: SparkSession, sf: str) -> DataFrame:
    return boards.started_and_stopped(views.events(spark, sf), "kind")


@query("WITH EV , x AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.t DESC, b.id DESC) AS r FROM ev a JOIN ev b ON b.channel = a.channel AND b.actor <> a.actor AND (b.t, b.id) < (a.t, a.id) AND b.t >= a.t - 86400) SELECT id, other, CAST(r AS INTEGER) AS nth FROM x WHERE r <= 3")
def before_context(spark: SparkSession, sf: str) -> DataFrame:
    return boards.before_context(views.events(spark, sf), "channel", 86400)


@query("WITH EV , o AS (SELECT actor, id, row_number() OVER (PARTITION BY actor ORDER BY t, id) AS r FROM ev), h AS (SELECT actor, kind, row_number() OVER (PARTITION BY actor ORDER BY md5('7:' || id::VARCHAR), id) AS r FROM ev) SELECT id, kind AS shuffled FROM o JOIN h USING (actor, r)")
def label_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return boards.label_shuffle(views.events(spark, sf), "kind", 7)


@query("WITH EV , s AS (SELECT kind AS feature, CASE id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'near' ELSE 'random' END AS set_, value > 50 AS picked FROM ev), c AS (SELECT feature, count_if(set_ = 'top' AND picked) AS tp, count_if(set_ = 'top') AS tn, count_if(set_ = 'near' AND picked) AS np, count_if(set_ = 'random' AND picked) AS rp, count_if(set_ = 'random') AS rn FROM s GROUP BY feature) SELECT feature, round(tp / (tp + np), 6) AS precision, round(tp / tn, 6) AS recall, round(rp / rn, 6) AS coverage FROM c")
def detection_scores(spark: SparkSession, sf: str) -> DataFrame:
    which = F.when(F.col("id") % 3 == 0, "top").when(F.col("id") % 3 == 1, "near").otherwise("random")
    return R6(boards.detection(views.events(spark, sf).select(F.col("kind").alias("feature"), which.alias("set"), (F.col("value") > 50).alias("picked"))), "precision", "recall", "coverage")


@query("WITH s AS (SELECT DISTINCT conv_id AS unit, turn AS line FROM conversations), m AS (SELECT DISTINCT role AS judge, conv_id AS unit, CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END AS feature, turn AS line FROM conversations), z AS (SELECT unit, count(*) AS size FROM s GROUP BY unit) SELECT m.unit, feature, round(count(*) / (max(size) * 2), 4) AS v FROM m JOIN s USING (unit, line) JOIN z ON z.unit = m.unit GROUP BY m.unit, feature")
def activation_shares(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    marks = c.select(F.col("role").alias("judge"), F.col("conv_id").alias("unit"), F.when(F.length("text") > 100, "long").otherwise("short").alias("feature"), F.col("turn").alias("line"))
    return boards.activation(marks, c.select(F.col("conv_id").alias("unit"), F.col("turn").alias("line")), 2)


@query("""WITH w AS (SELECT doc_id AS unit, source AS actor, lang AS channel, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z][a-z'']+)', 1))) AS word FROM documents), ta AS (SELECT count(*) >= 20 AS x FROM (SELECT actor FROM w GROUP BY actor HAVING count(DISTINCT unit) >= 2)), tc AS (SELECT count(*) >= 20 AS x FROM (SELECT channel FROM w GROUP BY channel HAVING count(DISTINCT unit) >= 2)), u AS (SELECT word, count(DISTINCT channel) AS channels, count(DISTINCT actor) AS actors FROM w GROUP BY word)
SELECT u.* FROM u, ta, tc WHERE (NOT tc.x OR channels >= 5) AND (NOT ta.x OR actors >= 5)""")
def topic_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import text as X

    p = views.posts(spark, sf)
    return boards.vocabulary(p.select(F.col("id").alias("unit"), "actor", "channel", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("word")))


@query("SELECT c.conv_id AS doc, count(DISTINCT k.id) AS ids, count_if(k.id IS NULL) AS dropped FROM (SELECT conv_id, turn + 2 AS line FROM conversations) c LEFT JOIN (SELECT DISTINCT conv_id AS doc, turn AS line, conv_id * 1000 + turn AS id FROM conversations) k ON k.doc = c.conv_id AND k.line = c.line GROUP BY 1", longs=("dropped",))
def cited_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"))
    return boards.cited(c.select("doc", (F.col("line") + 2).alias("line")), c.distinct().withColumn("id", F.col("doc") * 1000 + F.col("line")))


@query("WITH EV , c AS (SELECT DISTINCT t // 3600 AS chunk, t // 86400 AS day FROM ev), r AS (SELECT DISTINCT t // 3600 AS chunk FROM ev WHERE kind = 'view') SELECT day, count(*) AS chunks, count(r.chunk) AS read, count(r.chunk) = count(*) AS usable FROM c LEFT JOIN r USING (chunk) GROUP BY day")
def days_read(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumn("chunk", F.floor(F.col("t") / 3600))
    return boards.day_chunks_read(e.select("chunk", F.floor(F.col("t") / 86400).alias("day")).distinct(), e.filter("kind = 'view'"))


@query("SELECT name, printf('F%02d', row_number() OVER (ORDER BY CASE WHEN name LIKE '%STEEL%' THEN 0 ELSE 1 END, name)) AS number FROM (SELECT DISTINCT p_type AS name FROM part)")
def feature_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return boards.numbered(table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct(), F.contains("name", F.lit("STEEL")))


@query("SELECT p_partkey AS id, p_name AS name, trim(p_name) <> '' AND len(regexp_split_to_array(trim(p_name), '\\s+')) <= 4 AND length(p_name) <= 40 AND row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1 AS ok FROM part")
def short_names(spark: SparkSession, sf: str) -> DataFrame:
    return boards.short_names(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("WITH v AS (SELECT l_orderkey AS pair, l_linenumber % 2 = 0 AS swapped, l_quantity > 25 AS first_wins FROM lineitem), s AS (SELECT pair, swapped, CASE WHEN first_wins <> swapped THEN 'a' ELSE 'b' END AS side FROM v) SELECT pair, CASE WHEN count(DISTINCT side) = 1 AND count(DISTINCT swapped) = 2 THEN min(side) ELSE 'tie' END AS winner FROM s GROUP BY pair")
def agreed_preferences(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return boards.agreed_preferences(li.select(F.col("l_orderkey").alias("pair"), (F.col("l_linenumber") % 2 == 0).alias("swapped"), (F.col("l_quantity") > 25).alias("first_wins")))


@query("SELECT l_partkey AS id, arg_min(l_suppkey, (l_orderkey, l_suppkey)) AS source FROM lineitem GROUP BY 1")
def first_sources(spark: SparkSession, sf: str) -> DataFrame:
    return boards.first_source(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("step"), F.col("l_suppkey").alias("source")))


@query("WITH v AS (SELECT o_orderkey AS part, count(*) AS n, max(CASE WHEN o_totalprice > 150000 THEN 'accept' ELSE 'reject' END) AS verdict FROM orders GROUP BY 1), p AS (SELECT DISTINCT l_suppkey AS story, l_orderkey AS part FROM lineitem WHERE l_quantity > 49) SELECT story, bool_and(coalesce(n = 1 AND verdict = 'accept', false)) AS kept FROM p LEFT JOIN v USING (part) GROUP BY story")
def reviewed_stories(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("story"), F.col("l_orderkey").alias("part")).distinct()
    return boards.reviewed(parts, table(spark, sf, "orders").select(F.col("o_orderkey").alias("part"), F.when(F.col("o_totalprice") > 150000, "accept").otherwise("reject").alias("verdict")))


@query("WITH EV SELECT channel, count(*) AS n, round(avg(CASE WHEN kind = 'error' THEN 1 ELSE 0 END), 6) AS share, CASE WHEN avg(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) < 0.1 THEN '<10%' WHEN avg(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) < 0.3 THEN '<0.3' ELSE 'rest' END AS bin FROM ev WHERE value > 50 GROUP BY channel")
def also_bins(spark: SparkSession, sf: str) -> DataFrame:
    return R6(boards.also(views.events(spark, sf), "channel", F.col("value") > 50, F.col("kind") == "error"), "share")


@query("WITH EV , m AS (SELECT channel AS spec, id FROM ev UNION SELECT kind, id FROM ev WHERE kind = 'click') SELECT spec, count(DISTINCT id) AS n, count(DISTINCT id) >= greatest(8, 0.0003 * (SELECT count(*) FROM ev)) AND count(DISTINCT id) <= 0.3 * (SELECT count(*) FROM ev) AS valid FROM m GROUP BY spec")
def spec_validity(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return boards.spec_validity(e.select(F.col("channel").alias("spec"), "id").union(e.filter("kind = 'click'").select("kind", "id")), table(spark, sf, "events").count())


@query("WITH EV SELECT DISTINCT t // 3600 AS chunk FROM ev WHERE kind IN ('click', 'purchase')")
def live_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    doers = e.filter(F.col("kind").isin("click", "purchase")).select("id")
    return boards.live_chunks(e.select(F.floor(F.col("t") / 3600).alias("chunk"), "id"), doers, bool(e.filter("kind = 'view'").take(1)))


@query(f"""WITH EV , {REPLIES}, p AS (SELECT id, actor, channel, reply_to, row_number() OVER (PARTITION BY actor ORDER BY t, id) AS pa, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS pc, value, kind FROM r), s AS (SELECT * FROM p WHERE value > 95),
f AS (SELECT s.reply_to AS id, 'parent' AS reason, 1 AS distance FROM s WHERE s.reply_to IS NOT NULL UNION ALL SELECT p.id, 'child', 1 FROM p JOIN s ON p.reply_to = s.id UNION ALL SELECT p.id, 'same actor', abs(p.pa - s.pa) FROM p JOIN s ON p.actor = s.actor AND p.pa <> s.pa AND abs(p.pa - s.pa) <= 2 UNION ALL SELECT p.id, 'same place', abs(p.pc - s.pc) FROM p JOIN s ON p.channel = s.channel AND p.pc <> s.pc AND abs(p.pc - s.pc) <= 3),
b AS (SELECT id, min((distance, reason)) AS b FROM f WHERE id NOT IN (SELECT id FROM s) GROUP BY id) SELECT id, b[2] AS reason, CAST(b[1] AS INTEGER) AS distance FROM b""")
def evidence_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    e = relations.with_reply_to(views.events(spark, sf))
    return boards.neighbourhood(e, e.filter("value > 95").select("id"))
