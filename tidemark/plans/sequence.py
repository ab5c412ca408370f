"""Queries: as-of and interval joins, sessions, episodes, runs, neighbours, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, ranges, relations, sequences
from ..session import shuffle_partitions, table
from ..sources import views
from .registry import query

REPLIES = "r AS (SELECT *, CASE WHEN lag(actor) OVER w <> actor THEN lag(id) OVER w END AS reply_to FROM ev WINDOW w AS (PARTITION BY channel ORDER BY t, id)), ad AS (SELECT r.actor AS src, p.actor AS dst, r.t, r.id AS event_id FROM r JOIN ev p ON r.reply_to = p.id WHERE r.actor <> p.actor)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return relations.reply_edges(relations.with_reply_to(views.events(spark, sf)))


@query(f"WITH EV , {REPLIES} SELECT src, dst, t, event_id FROM ad")
def reply_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@query(f"""WITH EV , {REPLIES}, m AS (SELECT a.src, a.dst, a.t, a.event_id, min((b.t, b.event_id)) AS x FROM ad a JOIN ad b ON b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t <= a.t + 172800 GROUP BY ALL)
SELECT a.src, a.dst, a.t, a.event_id, m.x[1] AS r_t, m.x[2] AS r_id FROM ad a LEFT JOIN m USING (src, dst, t, event_id)""")
def replies_asof(spark: SparkSession, sf: str) -> DataFrame:
    return relations.answered(_edges(spark, sf), 172800)


@query(f"""WITH EV , {REPLIES}, m AS (SELECT a.src, a.dst, a.t, a.event_id, min((b.t, b.event_id)) AS x FROM ad a JOIN ad b ON b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t <= a.t + 172800 GROUP BY ALL)
SELECT DISTINCT dst AS src, src AS dst, x[2] AS event_id, x[1] AS t FROM m""")
def replied_relations(spark: SparkSession, sf: str) -> DataFrame:
    return relations.replied(relations.answered(_edges(spark, sf), 172800))


@query("""WITH EV , b AS (SELECT * FROM ev WHERE kind = 'purchase')
SELECT a.id, a.actor, a.t, b.t AS r_t, b.id AS r_id FROM ev a LEFT JOIN LATERAL (SELECT t, id FROM b WHERE b.actor = a.actor AND b.t <= a.t ORDER BY t DESC, id DESC LIMIT 1) b ON true WHERE a.kind = 'error'""")
def asof_last_purchase(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return sequences.asof_backward(e.filter("kind = 'error'").select("id", "actor", "t"), e.filter("kind = 'purchase'").select("id", "actor", "t"), ["actor"], ["id"])


@query("""WITH EV , b AS (SELECT * FROM ev WHERE kind = 'click')
SELECT a.id, a.actor, a.t, b.t AS r_t, b.id AS r_id FROM ev a LEFT JOIN LATERAL (SELECT t, id FROM b WHERE b.actor = a.actor AND b.t >= a.t AND b.t <= a.t + 86400 ORDER BY t, id LIMIT 1) b ON true WHERE a.kind = 'view'""")
def asof_forward_day(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return sequences.asof_forward(e.filter("kind = 'view'").select("id", "actor", "t"), e.filter("kind = 'click'").select("id", "actor", "t"), ["actor"], 86400, strict=False)


@query("""WITH RECURSIVE EV , o AS (SELECT actor, t, id, row_number() OVER (PARTITION BY actor ORDER BY t, id) AS r FROM ev),
s AS (SELECT actor, t, id, r, t AS start_t FROM o WHERE r = 1 UNION ALL SELECT o.actor, o.t, o.id, o.r, CASE WHEN o.t - s.t > 21600 OR o.t - s.start_t > 86400 THEN o.t ELSE s.start_t END FROM s JOIN o ON o.actor = s.actor AND o.r = s.r + 1)
SELECT actor, start_t, max(t) AS end_t, count(*) AS n, sum(id)::BIGINT AS id_sum FROM (SELECT *, count_if(brk) OVER (PARTITION BY actor ORDER BY r) AS g FROM (SELECT *, r = 1 OR start_t <> lag(start_t) OVER (PARTITION BY actor ORDER BY r) OR t - lag(t) OVER (PARTITION BY actor ORDER BY r) > 21600 AS brk FROM s)) GROUP BY actor, start_t, g""")
def stretches_long(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences.stretches(views.events(spark, sf), "actor", 21600, 86400)
    return s.select("actor", "start_t", "end_t", "n", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("""WITH EV , m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY actor, channel ORDER BY t, id) > 86400 THEN 1 ELSE 0 END AS brk FROM ev), s AS (SELECT *, sum(brk) OVER (PARTITION BY actor, channel ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS incident FROM m)
SELECT actor, channel, incident, count(*) AS n, min(t) AS start_t, max(t) AS end_t, count(DISTINCT kind) AS kinds FROM s GROUP BY ALL""")
def gap_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.incidents(views.events(spark, sf), ["actor", "channel"], 86400)


@query("WITH EV SELECT actor, kind, id FROM (SELECT *, t - lag(t) OVER (PARTITION BY actor, kind ORDER BY t, id) AS g FROM ev) WHERE g IS NULL OR g >= 86400")
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.episodes(views.events(spark, sf), ["actor", "kind"], 86400).select("actor", "kind", "id")


@query("""WITH EV , c AS (SELECT actor, t, count(*) OVER (PARTITION BY actor ORDER BY t RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS c FROM ev)
SELECT actor, most, min(t) AS start_t FROM (SELECT *, max(c) OVER (PARTITION BY actor) AS most FROM c) WHERE c = most GROUP BY actor, most""")
def burst_max(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.burst(views.events(spark, sf), ["actor"], 86400)


@query("""WITH EV , n AS (SELECT id AS u, lead(id) OVER w AS v, lead(t) OVER w - t AS lag FROM ev WINDOW w AS (PARTITION BY actor ORDER BY t, id)) SELECT u, v, lag FROM n WHERE lag <= 43200""")
def next_edges(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.next_of_key(views.events(spark, sf), ["actor"], 43200)


@query("""WITH EV SELECT a.id AS u, b.id AS v FROM ev a, LATERAL (SELECT id, t FROM ev b WHERE b.channel = a.channel AND b.actor <> a.actor AND (b.t, b.id) > (a.t, a.id) ORDER BY t, id LIMIT 1) b WHERE b.t - a.t <= 43200""")
def next_other_actor(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.next_other_actor(views.events(spark, sf), "channel", 43200)


@query("""WITH EV , p AS (SELECT u.id AS u, v.id AS v, row_number() OVER (PARTITION BY v.id ORDER BY u.t DESC, u.id DESC) AS r FROM ev v JOIN ev u ON u.channel = v.channel AND u.actor <> v.actor AND u.t >= v.t - 86400 AND (u.t, u.id) < (v.t, v.id))
SELECT u, v FROM p WHERE r <= 3""")
def channel_edges_prev3(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.previous_others(views.events(spark, sf), "channel", 3, 86400).select("u", "v")


@query("""WITH EV , m AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS brk FROM ev WINDOW w AS (PARTITION BY actor ORDER BY t, id)), s AS (SELECT *, sum(brk) OVER (PARTITION BY actor ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT actor, kind, count(*) AS n, min(t) AS start_t, max(t) AS end_t FROM s GROUP BY actor, g, kind HAVING count(*) >= 3""")
def folded_runs(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.runs(views.events(spark, sf), ["actor"], "kind", 3)


@query("""WITH EV , g AS (SELECT actor, t - lag(t) OVER (PARTITION BY actor ORDER BY t, id) AS gap FROM ev), m AS (SELECT actor, quantile_cont(gap, 0.5) AS median_gap, count(gap) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY actor)
SELECT m.actor, round(median_gap, 6) AS median_gap, gaps, count_if(gap > greatest(21600.0, 10 * median_gap)) AS pauses FROM m JOIN g USING (actor) WHERE gap IS NOT NULL GROUP BY ALL""", longs=("pauses",))
def median_gaps(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences.median_gap(views.events(spark, sf), ["actor"])
    return out.withColumn("median_gap", F.round("median_gap", 6))


@query(f"""WITH EV , {REPLIES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count_if(src < dst) AS a_to_b, count_if(src > dst) AS b_to_a, round(least(count_if(src < dst), count_if(src > dst)) / greatest(count_if(src < dst), count_if(src > dst)), 6) AS reciprocity FROM ad GROUP BY 1, 2""", longs=("a_to_b", "b_to_a"))
def pair_reciprocity(spark: SparkSession, sf: str) -> DataFrame:
    return relations.reciprocity(_edges(spark, sf)).withColumn("reciprocity", F.round("reciprocity", 6))


@query("SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS n, count(DISTINCT o_orderkey) AS orders, CAST(min(epoch(l_shipdate)) AS BIGINT) AS first_t FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) >= 3")
def shipment_relations(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return relations.shipped(table(spark, sf, "orders"), lines, max(shuffle_partitions(spark), -(-size // (16 << 20))))  # 16 MB of files to a task


@query(f"""WITH EV , {REPLIES}, x AS (SELECT 0 AS rank, 'to_field' AS method, src, dst, t, event_id FROM ad WHERE event_id % 2 = 0 UNION ALL SELECT 1, 'reply_field', src, dst, t, event_id FROM ad WHERE event_id % 3 = 0 UNION ALL SELECT 2, 'mention', src, dst, t, event_id FROM ad)
SELECT src, dst, t, event_id, method FROM (SELECT *, row_number() OVER (PARTITION BY event_id, dst ORDER BY rank) AS r FROM x) WHERE r = 1""")
def first_method_union(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    return relations.first_method([("to_field", e.filter("event_id % 2 = 0")), ("reply_field", e.filter("event_id % 3 = 0")), ("mention", e)])


@query(f"""WITH EV , {REPLIES}, an AS (SELECT a.*, (SELECT min((b.t, b.event_id)) FROM ad b WHERE b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t <= a.t + 172800) AS x FROM ad a),
own AS (SELECT actor, (t - 345600) // 604800 AS segment, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM ev GROUP BY ALL), o AS (SELECT src AS actor, (t - 345600) // 604800 AS segment, count(*) AS n_out FROM ad GROUP BY ALL),
i AS (SELECT dst AS actor, (t - 345600) // 604800 AS segment, count(*) AS n_in, count(x) AS answered FROM an GROUP BY ALL),
pc AS (SELECT actor, (t - 345600) // 604800 AS segment, peer, count(*) AS c FROM (SELECT src AS actor, dst AS peer, t FROM ad UNION ALL SELECT dst, src, t FROM ad) GROUP BY ALL),
pr AS (SELECT actor, segment, string_agg(peer::VARCHAR, ',' ORDER BY r) AS peers FROM (SELECT *, row_number() OVER (PARTITION BY actor, segment ORDER BY c DESC, peer) AS r FROM pc) WHERE r <= 5 GROUP BY ALL)
SELECT own.actor, own.segment::BIGINT AS segment, first_t, last_t, n, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(answered, 0) AS answered, peers, round(answered / n_in, 6) AS answered_share FROM own LEFT JOIN o USING (actor, segment) LEFT JOIN i USING (actor, segment) LEFT JOIN pr USING (actor, segment)""")
def nodes_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    edges = _edges(spark, sf)
    out = relations.nodes(e, edges, relations.answered(edges, 172800), F.floor((F.col("t") - 345600) / 604800))
    return out.withColumn("answered_share", F.round("answered_share", 6))


REACTION = """WITH EV , tr AS (SELECT id AS tid, actor, {key} AS key, t AS tt FROM ev WHERE kind = '{a}'), w AS (SELECT tid, actor, key, k, tt + k * {w} AS lo, tt + k * {w} + {w} AS hi FROM tr, (VALUES (0), (-4), (-3), (2), (3)) v(k)),
x AS (SELECT tid, k, bool_or(e.id IS NOT NULL) AS active, bool_or(coalesce(e.kind = '{b}', false)) AS hit FROM w LEFT JOIN ev e ON e.{key} = w.key AND e.t > w.lo AND e.t <= w.hi {more} GROUP BY tid, k)
SELECT count_if(k = 0) AS triggers, count_if(k = 0 AND hit) AS responded, count_if(k <> 0 AND active) AS base_windows, count_if(k <> 0 AND active AND hit) AS base_hits FROM x"""


@query(REACTION.format(key="actor", a="view", b="click", w=43200, more=""), longs=("triggers", "responded", "base_windows", "base_hits"))
def reaction_lift(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.reaction(views.events(spark, sf), F.col("kind") == "view", F.col("kind") == "click", 43200)


@query(REACTION.format(key="channel", a="purchase", b="error", w=21600, more="AND e.actor <> w.actor"), longs=("triggers", "responded", "base_windows", "base_hits"))
def channel_reaction(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.reaction(views.events(spark, sf), F.col("kind") == "purchase", F.col("kind") == "error", 21600, ["channel"], others=True)


@query("""WITH EV , w AS (SELECT kind AS a, id AS wid, actor, k, t + k * 43200 AS lo, t + k * 43200 + 43200 AS hi FROM ev, (VALUES (0), (-3), (-2), (2), (3)) v(k)), seen AS (SELECT DISTINCT w.wid, w.k, w.a, e.kind AS b FROM w JOIN ev e ON e.actor = w.actor AND e.t > w.lo AND e.t <= w.hi)
SELECT a, b, followed, base_hits, n_a, base_windows FROM (SELECT a, b, count_if(k = 0) AS followed, count_if(k <> 0) AS base_hits FROM seen WHERE a <> b GROUP BY a, b) JOIN (SELECT kind AS a, count(*) AS n_a FROM ev GROUP BY kind) USING (a) LEFT JOIN (SELECT a, count(DISTINCT (wid, k)) AS base_windows FROM seen WHERE k <> 0 GROUP BY a) USING (a)""", longs=("followed", "base_hits"))
def after_then_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.after_pairs(views.events(spark, sf), 43200)


@query(f"""WITH EV , {REPLIES}, f AS (SELECT actor, min(t) AS first_t FROM ev WHERE kind = 'purchase' AND value > 80 GROUP BY actor), c AS (SELECT x, y, min(t) AS met FROM (SELECT src AS x, dst AS y, t FROM ad UNION ALL SELECT dst, src, t FROM ad) GROUP BY x, y)
SELECT count(*) AS adopters, count_if(EXISTS (SELECT 1 FROM c JOIN f g ON c.y = g.actor WHERE c.x = f.actor AND g.first_t < f.first_t AND c.met < f.first_t)) AS linked FROM f""", longs=("linked",))
def spread_contact(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.contact_spread(views.events(spark, sf), _edges(spark, sf), (F.col("kind") == "purchase") & (F.col("value") > 80))


@query("""WITH EV , a AS (SELECT DISTINCT actor, channel FROM ev WHERE kind = 'signup') SELECT x.channel AS a, y.channel AS b, count(*) AS n FROM a x JOIN a y ON x.actor = y.actor AND x.channel < y.channel GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_occurs(spark: SparkSession, sf: str) -> DataFrame:
    a = views.events(spark, sf).filter("kind = 'signup'").select("actor", "channel").distinct()
    b = a.withColumnRenamed("channel", "b")
    return a.join(b, "actor").filter("channel < b").groupBy(F.col("channel").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("""WITH c AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before_turn FROM conversations)
SELECT role, before_role, count(*) AS n, CAST(max(turn - before_turn) AS BIGINT) AS longest FROM c GROUP BY ALL""")
def turn_transitions(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("role", "turn", F.lag("role").over(w).alias("before_role"), F.lag("turn").over(w).alias("before_turn"))
    return c.groupBy("role", "before_role").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn") - F.col("before_turn")).alias("longest"))
