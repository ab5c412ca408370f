"""Queries: cards and views, batches, incident graphs, and lists for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boards, cards, flow, ranges, relations
from ..session import table
from ..sources import views
from .boards import FLAGS, _flags
from .flows import UNITS_SQL, _flow
from .measures import R6
from .registry import query
from .sequence import REPLIES


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return relations.reply_edges(relations.with_reply_to(views.events(spark, sf)))


@query(f"WITH EV , {REPLIES}, x AS (SELECT 'reply' AS etype, event_id AS v, src AS u FROM ad UNION ALL SELECT 'next', id, lag(id) OVER (PARTITION BY actor ORDER BY t, id) FROM ev UNION ALL SELECT 'channel', id, lag(id) OVER (PARTITION BY channel ORDER BY t, id) FROM ev) SELECT DISTINCT v, u FROM x WHERE etype IN ('next', 'channel') AND u IS NOT NULL")
def exposure_union(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    typed = _edges(spark, sf).select(F.lit("reply").alias("etype"), F.col("event_id").alias("v"), F.col("src").alias("u"))
    for name, key in (("next", "actor"), ("channel", "channel")):
        typed = typed.union(e.select(F.lit(name), "id", F.lag("id").over(Window.partitionBy(key).orderBy("t", "id"))))
    return boards.exposure(typed.filter("u is not null"), ["next", "channel"])


@query("""WITH RECURSIVE EV , h AS (SELECT id, actor, channel, t FROM ev WHERE value > 60), l AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.channel = b.channel AND a.id < b.id AND b.t - a.t <= 86400), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT id, id AS root FROM h UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id, min(root) AS "group" FROM r GROUP BY id""")
def incident_components(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents of one place within a day of each other, grouped; only neighbours in time are linked, which groups the same."""
    h = views.events(spark, sf).filter("value > 60").select("id", "channel", "t")
    w = Window.partitionBy("channel").orderBy("t", "id")
    links = h.select(F.col("id").alias("a"), F.lead("id").over(w).alias("b"), (F.lead("t").over(w) - F.col("t")).alias("gap")).filter("b is not null and gap <= 86400")
    return cards.components(h, links)


@query(f"WITH EV , {REPLIES}, i AS (SELECT id, actor, t FROM ev WHERE value > 30), x AS (SELECT 1 AS k, 'responds' AS type, r.reply_to AS src, r.id AS dst FROM r WHERE reply_to IN (SELECT id FROM i) AND id IN (SELECT id FROM i) UNION ALL SELECT 2, 'same actor', id, lead(id) OVER (PARTITION BY actor ORDER BY t, id) FROM i) SELECT src, dst, arg_min(type, k) AS type FROM x JOIN i a ON a.id = src JOIN i b ON b.id = dst WHERE src <> dst AND a.t <= b.t GROUP BY ALL")
def incident_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = relations.with_reply_to(views.events(spark, sf))
    i = e.filter("value > 30").select("id", "actor", "t")
    responds = e.filter("reply_to is not null").select(F.lit("responds").alias("type"), F.col("reply_to").alias("src"), F.col("id").alias("dst"))
    return cards.first_edges(responds.unionByName(cards.same_actor_edges(i)), i.select("id", "t"), ["responds", "same actor"])


@query("""WITH EV , u AS (SELECT *, actor * 1000 + t // 86400 AS unit FROM ev), g AS (SELECT unit, t, t - lag(t) OVER (PARTITION BY unit ORDER BY t, id) AS gap FROM u), k AS (SELECT unit, max(c) / sum(c) AS top_share FROM (SELECT unit, kind, count(*) AS c FROM u GROUP BY ALL) GROUP BY unit)
SELECT unit, round(ln(1 + count(*)), 6) AS log_events, round(ln(1 + max(t) - min(t)), 6) AS log_span, round(any_value(top_share), 6) AS top_share, round(CASE WHEN count(gap) >= 2 AND stddev_pop(gap) + avg(gap) > 0 THEN (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) END, 6) AS burstiness FROM g JOIN k USING (unit) GROUP BY unit""")
def stretch_features(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    u = e.withColumn("unit", F.col("actor") * 1000 + F.floor(F.col("t") / 86400))
    return R6(cards.stretch_features(u, "unit"), "log_events", "log_span", "top_share", "burstiness")


@query("WITH EV , s AS (SELECT channel, id, row_number() OVER w AS place, length(meta) AS size FROM ev WINDOW w AS (PARTITION BY channel ORDER BY t, id)) SELECT channel, id, CAST(coalesce(sum(size) OVER (PARTITION BY channel ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 60 AS BIGINT) AS batch FROM s")
def reader_batches(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("channel").orderBy("t", "id")
    items = views.events(spark, sf).select("channel", "id", F.row_number().over(w).alias("place"), F.length("meta").alias("size"))
    return cards.batches(items, "channel", 60).select("channel", "id", "batch")


@query("WITH EV , c AS (SELECT *, ntile(5) OVER (PARTITION BY kind ORDER BY t, id) AS cell FROM ev), h AS (SELECT kind, cell, arg_min(actor, (t, id)) AS head FROM c GROUP BY ALL), b AS (SELECT kind, cell, lag(head) OVER (PARTITION BY kind ORDER BY cell) AS before FROM h) SELECT kind, CAST(cell AS INTEGER) AS cell, arg_min(id, (CASE WHEN actor = before THEN 1 ELSE 0 END, t, id)) AS id FROM c JOIN b USING (kind, cell) GROUP BY ALL")
def evenly_spaced(spark: SparkSession, sf: str) -> DataFrame:
    return cards.evenly_spaced(views.events(spark, sf), "kind", 5)


@query("WITH EV , x AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS place, row_number() OVER (PARTITION BY channel ORDER BY t DESC, id DESC) AS from_end FROM ev) SELECT channel, id, CAST(place AS INTEGER) AS place, CAST(from_end AS INTEGER) AS from_end FROM x WHERE place <= 4 OR from_end <= 3")
def card_ends(spark: SparkSession, sf: str) -> DataFrame:
    return cards.ends(views.events(spark, sf), "channel", 4, 3)


def _top_sql(side: str, other: str) -> str:
    return f"(SELECT actor, string_agg(peer::VARCHAR, ',' ORDER BY r) AS peers FROM (SELECT actor, peer, row_number() OVER (PARTITION BY actor ORDER BY c DESC, peer) AS r FROM (SELECT {side} AS actor, {other} AS peer, count(*) AS c FROM ad GROUP BY ALL)) WHERE r <= 6 GROUP BY actor)"


@query(f"WITH EV , {REPLIES}, o AS (SELECT actor, count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(DISTINCT channel) AS places, round(count(*) / (SELECT count(*) FROM ev), 6) AS share FROM ev GROUP BY actor) SELECT o.*, a.peers AS links_out, b.peers AS links_in FROM o LEFT JOIN {_top_sql('src', 'dst')} a USING (actor) LEFT JOIN {_top_sql('dst', 'src')} b USING (actor)")
def actor_views(spark: SparkSession, sf: str) -> DataFrame:
    return R6(cards.node_view(views.events(spark, sf), _edges(spark, sf)), "share")


@query(f"WITH EV , {FLAGS} SELECT kind, count(DISTINCT event_id) AS events, round(count(DISTINCT event_id) / (SELECT count(*) FROM ev), 6) AS share, count(DISTINCT event_id) / (SELECT count(*) FROM ev) >= 0.05 AS dominant FROM fg GROUP BY kind")
def concern_board(spark: SparkSession, sf: str) -> DataFrame:
    return R6(cards.concern_board(_flags(spark, sf), table(spark, sf, "events").count(), 0.05), "share")


@query(f"WITH EV , {FLAGS} SELECT event_id, kind, actor, t, after FROM fg WHERE confidence = 'high' AND kind = 'error'")
def concern_listing(spark: SparkSession, sf: str) -> DataFrame:
    return _flags(spark, sf).filter("confidence = 'high' and kind = 'error'").select("event_id", "kind", "actor", "t", "after")


@query("""WITH EV , r AS (SELECT t // 3600 AS chunk, count_if(kind = 'error' AND value > 30) AS said, count_if(kind = 'click' AND value > 30) AS instructions, count_if(kind = 'view' AND value > 30) AS concerns FROM ev GROUP BY 1) SELECT chunk, CAST(said AS INTEGER) AS said, CAST(instructions AS INTEGER) AS instructions, CAST(concerns AS INTEGER) AS concerns FROM r""")
def reading_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Readings are written as JSON, as a reader would hand them in, and tallied from it."""
    e = views.events(spark, sf).withColumn("high", F.col("value") > 30)

    def rows(kind: str, field: str, yes: str, no: str):
        return F.collect_list(F.when(F.col("kind") == kind, F.struct(F.when(F.col("high"), yes).otherwise(no).alias(field))))

    packed = e.groupBy(F.floor(F.col("t") / 3600).alias("chunk")).agg(rows("error", "how", "overstates", "fair").alias("said"), rows("click", "outcome", "broke", "kept").alias("instructions"), rows("view", "confidence", "high", "low").alias("concerns"))
    return cards.tallies(packed.select("chunk", F.to_json(F.struct("said", "instructions", "concerns")).alias("json")))


@query("""WITH EV , i AS (SELECT channel AS rule, id, t, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS r FROM ev WHERE value > 20), o AS (SELECT rule, min(t) AS t, string_agg(id::VARCHAR, ',' ORDER BY r) FILTER (r <= 12) AS evidence FROM i GROUP BY rule), p AS (SELECT 1704067200 + w * 172800 AS start, 'p' || w AS period FROM range(0, 12) x(w)) SELECT o.rule, o.t, (SELECT arg_max(period, start) FROM p WHERE start <= o.t) AS in_force, evidence FROM o""")
def merged_rules(spark: SparkSession, sf: str) -> DataFrame:
    items = views.events(spark, sf).filter("value > 20").select(F.col("channel").alias("rule"), "id", "t")
    periods = spark.range(12).select((F.lit(1704067200) + F.col("id") * 172800).alias("start"), F.concat(F.lit("p"), "id").alias("period"))
    return cards.merged_rules(items, periods)


@query(f"WITH {UNITS_SQL}, j AS (SELECT id AS unit FROM ev WHERE value > 50) SELECT DISTINCT ed.u AS unit FROM ed JOIN j ON j.unit = ed.v JOIN un a ON a.unit = ed.u JOIN un b ON b.unit = ed.v WHERE a.t <= b.t AND ed.u NOT IN (SELECT unit FROM j)")
def flow_sample(spark: SparkSession, sf: str) -> DataFrame:
    units, _, edges = _flow(spark, sf)
    return cards.unjudged_sources(edges, units.select("unit", "t"), views.events(spark, sf).filter("value > 50").select(F.col("id").alias("unit")))


@query("""WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) WHERE embedding IS NOT NULL GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM x GROUP BY label), d AS (SELECT c.label, e.vec_id, round(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS d FROM embeddings e JOIN c ON c.label <> e.label WHERE e.embedding IS NOT NULL)
SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS INTEGER) AS place FROM d QUALIFY place <= 5""")
def near_types(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").filter("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return cards.near_centroid(v, "label", 5)


@query("WITH EV SELECT kind AS feature, count(DISTINCT actor) AS n, round(count(DISTINCT actor) / (SELECT count(DISTINCT actor) FROM ev), 6) AS density, round(-log2(count(DISTINCT actor) / (SELECT count(DISTINCT actor) FROM ev)), 6) AS bits FROM ev WHERE value > 60 GROUP BY kind")
def feature_bits(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return R6(cards.densities(e.filter("value > 60").select(F.col("kind").alias("feature"), F.col("actor").alias("unit")), e.select("actor").distinct().count()), "density", "bits")


@query(f"""WITH {UNITS_SQL}, w AS (SELECT *, t >= 1705276800 AS late FROM un), n AS (SELECT count_if(NOT late) AS n0, count_if(late) AS n1 FROM w), k AS (SELECT feature, count_if(NOT late) AS k0, count_if(late) AS k1 FROM has JOIN w USING (unit) GROUP BY feature), z AS (SELECT feature, round((k1 / n1 - k0 / n0) / sqrt((k1 + k0) / (n1 + n0) * (1 - (k1 + k0) / (n1 + n0)) * (1 / n1 + 1 / n0)), 6) AS z FROM k, n),
l AS (SELECT *, CASE WHEN z > 0 THEN 'higher' ELSE 'lower' END AS list FROM z WHERE abs(z) >= 0.2) SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY abs(z) DESC, feature) AS INTEGER) AS place, feature, z FROM l QUALIFY place <= 5""")
def shift_lists(spark: SparkSession, sf: str) -> DataFrame:
    units, has, _ = _flow(spark, sf)
    return cards.shift_lists(R6(flow.shift(units, has, F.col("t") < 1705276800, F.col("t") >= 1705276800), "z"), 5, 0.2)


def _gaps_sql(where: str) -> str:
    return f"(WITH e AS (SELECT * FROM ev WHERE {where}), w AS (SELECT actor, kind AS a, id, k, t + k * 86400 AS lo FROM e, (VALUES (0), (-3), (-2), (2), (3)) o(k)), s AS (SELECT w.a, w.id, w.k, e.kind AS b FROM w JOIN e ON e.actor = w.actor AND e.t > w.lo AND e.t <= w.lo + 86400 GROUP BY ALL), n AS (SELECT kind AS a, count(*) AS n FROM e GROUP BY 1), bw AS (SELECT a, count(DISTINCT (id, k)) AS bw FROM s WHERE k <> 0 GROUP BY a), h AS (SELECT a, b, count_if(k = 0) AS f, count_if(k <> 0) AS bh FROM s WHERE a <> b GROUP BY ALL) SELECT a, b, f / n - bh / bw AS gap FROM h JOIN n USING (a) JOIN bw USING (a))"


@query(f"WITH EV SELECT count(*) AS pairs, round(avg(CASE WHEN sign(x.gap) = sign(y.gap) THEN 1 ELSE 0 END), 6) AS same_sign, round(corr(x.gap, y.gap), 6) AS correlation FROM {_gaps_sql('t < 1705276800')} x JOIN {_gaps_sql('t >= 1705276800')} y USING (a, b)")
def lead_replication(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    gap = F.col("followed") / F.col("n_a") - F.col("base_hits") / F.col("base_windows")
    early, late = (ranges.after_pairs(e.filter(x), 86400).filter("base_windows > 0").select("a", "b", gap.alias("gap")) for x in ("t < 1705276800", "t >= 1705276800"))
    return R6(cards.replication(early, late), "same_sign", "correlation")


@query("WITH EV , x AS (SELECT channel, id, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS p, sum(length(meta)) OVER (PARTITION BY channel) AS total FROM ev) SELECT channel, id FROM x WHERE (p - 1) % greatest(1, CAST(ceil(total / 30) AS BIGINT)) = 0")
def thinned_to_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return cards.sampled_to_bytes(views.events(spark, sf).withColumn("size", F.length("meta")), "channel", 30)


@query(f"WITH EV , {REPLIES}, m AS (SELECT a.src, a.dst, a.event_id, count(b.event_id) > 0 AS ok FROM ad a LEFT JOIN ad b ON b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t <= a.t + 172800 GROUP BY a.src, a.dst, a.t, a.event_id) SELECT src, dst, count(DISTINCT event_id) AS n, count_if(ok) AS answered, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS rate FROM m GROUP BY ALL", longs=("answered",))
def answered_rates(spark: SparkSession, sf: str) -> DataFrame:
    return R6(cards.reciprocal_rates(relations.answered(_edges(spark, sf), 172800)), "rate")


def _placed_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL SELECT a, arg_min(value, (-w, b)), {k} FROM bo JOIN p{k - 1} p ON p.unit = bo.b WHERE a NOT IN (SELECT unit FROM p{k - 1}) GROUP BY a)")
    return ", ".join(steps)


@query(f"WITH EV , l AS (SELECT actor AS a, channel::INTEGER + 1000 AS b, count(*) AS w FROM ev GROUP BY ALL), bo AS (SELECT a, b, w FROM l UNION ALL SELECT b, a, w FROM l), p0 AS (SELECT DISTINCT actor AS unit, 'k' || actor % 3 AS value, 0 AS round FROM ev WHERE actor % 10 = 1), {_placed_sql(4)} SELECT unit, value, round FROM p4")
def placed_units(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    links = e.groupBy(F.col("actor").alias("a"), (F.col("channel").cast("int") + 1000).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    known = e.filter("actor % 10 = 1").select(F.col("actor").alias("unit"), F.concat(F.lit("k"), F.col("actor") % 3).alias("value")).distinct()
    return cards.placed_by_neighbours(known, links)


@query("WITH EV , r AS (SELECT channel, kind AS text, row_number() OVER (PARTITION BY channel ORDER BY t, id) AS line, count(*) OVER (PARTITION BY channel) AS n FROM ev) SELECT channel, CAST(line AS INTEGER) AS line, text FROM r WHERE n <= 6 OR line <= 3 OR line > n - 3 UNION ALL SELECT channel, CAST(line AS INTEGER), (n - 6) || ' hidden' FROM r WHERE n > 6 AND line = 4")
def judge_lines(spark: SparkSession, sf: str) -> DataFrame:
    return cards.folded_middle(views.events(spark, sf), "channel", "kind", 6)


@query("WITH RECURSIVE l AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place, l_partkey::VARCHAR AS payload FROM lineitem), r AS (SELECT run, 1::BIGINT AS place, sha256(payload) AS hash FROM l WHERE place = 1 UNION ALL SELECT l.run, l.place, sha256(r.hash || l.payload) FROM r JOIN l ON l.run = r.run AND l.place = r.place + 1) SELECT run, CAST(place AS INTEGER) AS place, hash FROM r")
def replay_hashes(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    stages = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.row_number().over(w).alias("place"), F.col("l_partkey").cast("string").alias("payload"))
    return cards.hash_chain(stages, "run")


@query("""WITH EV , s AS (SELECT DISTINCT channel AS scene, 1704067200 + channel::INTEGER * 20000 AS start, 1704067200 + 1500000 - CASE WHEN channel::INTEGER > 90 THEN 1500000 ELSE 0 END AS "end" FROM ev), c AS (SELECT channel AS scene, CASE WHEN value > 98 THEN -id ELSE id END AS id FROM ev WHERE value > 80), k AS (SELECT DISTINCT c.*, e.t, s.start, s."end" FROM c JOIN s USING (scene) LEFT JOIN ev e ON e.id = c.id), n AS (SELECT scene, count(DISTINCT id) AS n FROM c GROUP BY scene)
SELECT scene, 'backwards' AS fault FROM s WHERE "end" < start UNION SELECT scene, 'no evidence' FROM s WHERE scene NOT IN (SELECT scene FROM n) UNION SELECT scene, 'too many' FROM n WHERE n > 3 UNION SELECT scene, 'unknown' FROM k WHERE t IS NULL UNION SELECT scene, 'outside' FROM k WHERE t < start OR t > "end" """)
def plan_faults(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    number = F.col("scene").cast("int")
    scenes = e.select(F.col("channel").alias("scene")).distinct().select("scene", (F.lit(1704067200) + number * 20000).alias("start"), (F.lit(1704067200 + 1500000) - F.when(number > 90, 1500000).otherwise(0)).alias("end"))
    cites = e.filter("value > 80").select(F.col("channel").alias("scene"), F.when(F.col("value") > 98, -F.col("id")).otherwise(F.col("id")).alias("id"))
    return cards.plan_faults(scenes, cites, e, 3)
