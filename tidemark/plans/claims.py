"""Queries: claims by scope with verdicts, spread with its base, joint occurrence, reactions and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import claims, metrics, ranges, relations
from ..sources import views
from .measures import R6
from .registry import query
from .sequence import REPLIES

WIDTH = 86400


def _scope_sql(scope: str) -> str:
    key = "channel" if scope == "others_same_place" else "actor"
    keyed = {"same_actor": "SELECT id, t, actor AS ta, actor AS key FROM a", "others_same_place": "SELECT id, t, actor AS ta, channel AS key FROM a", "target": "SELECT DISTINCT a.id, a.t, a.actor AS ta, ad.dst AS key FROM a JOIN ad ON ad.event_id = a.id WHERE ad.dst <> a.actor"}[scope]
    group = "min(key)" if scope == "target" else "min(ta)"
    other = "AND m.actor <> w.ta" if scope == "others_same_place" else ""
    return f"""SELECT * FROM (WITH EV , {REPLIES}, a AS (SELECT * FROM ev WHERE kind = 'click'), m AS (SELECT {key} AS key, id, actor, t, kind = 'purchase' AS b FROM ev), c AS ({keyed}), g AS (SELECT id, min(t) AS t, {group} AS grp FROM c GROUP BY id), sp AS (SELECT c.id, min(m.t) AS s, max(m.t) AS e FROM c JOIN m USING (key) GROUP BY c.id),
w AS (SELECT c.id, c.key, c.ta, k, c.t + k * {WIDTH} AS lo FROM c JOIN sp USING (id), (VALUES (0), (-3), (-2), (2), (3)) o(k) WHERE k = 0 OR (c.t + k * {WIDTH} >= s AND c.t + (k + 1) * {WIDTH} <= e)), x AS (SELECT w.id, k, bool_or(m.b) AS hit FROM w JOIN m ON m.key = w.key AND m.t > w.lo AND m.t <= w.lo + {WIDTH} {other} GROUP BY ALL),
rw AS (SELECT g.id, g.t, grp, coalesce(count_if(k = 0), 0) > 0 AS active, count_if(k = 0 AND hit) AS hit, count_if(k <> 0) AS bn, count_if(k <> 0 AND hit) AS bh FROM g LEFT JOIN x USING (id) GROUP BY ALL), q AS (SELECT * FROM rw WHERE active AND bn > 0), mi AS (SELECT (SELECT t FROM q ORDER BY t LIMIT 1 OFFSET (SELECT count(*) // 2 FROM q)) AS mid),
wh AS (SELECT count(*) AS cases, count(DISTINCT grp) AS groups, avg(hit) AS rate, sum(bh) / sum(bn) AS base, count_if(t < mid) AS cases_1, sum(CASE WHEN t < mid THEN hit END) / count_if(t < mid) - sum(CASE WHEN t < mid THEN bh END) / sum(CASE WHEN t < mid THEN bn END) AS gap_1, count_if(t >= mid) AS cases_2, sum(CASE WHEN t >= mid THEN hit END) / count_if(t >= mid) - sum(CASE WHEN t >= mid THEN bh END) / sum(CASE WHEN t >= mid THEN bn END) AS gap_2 FROM q, mi),
gs AS (SELECT grp, count(*) AS c, sum(hit) AS f, sum(bh) AS bh, sum(bn) AS bn, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS k FROM q GROUP BY grp), dr AS (SELECT r, ('0x' || substr(md5('5:' || r || ':' || i), 1, 8))::BIGINT % k AS i FROM gs, range(300) x(r)), df AS (SELECT sum(f) / sum(c) - sum(bh) / sum(bn) AS d FROM dr JOIN gs USING (i) GROUP BY r), lo AS (SELECT list_sort(list(d))[CAST(floor(0.05 * count(*)) AS INTEGER) + 1] AS low FROM df),
o AS (SELECT *, CASE WHEN cases >= 15 AND rate - base >= 0.05 THEN low END AS gap_ci_low, (SELECT count_if(active AND bn = 0) FROM rw) AS unpaired, (SELECT count_if(NOT active) FROM rw) AS silent FROM wh, lo)
SELECT '{scope}' AS scope, cases, CAST(unpaired AS BIGINT) AS unpaired, CAST(silent AS BIGINT) AS silent, groups, round(rate, 6) AS rate, round(base, 6) AS base, CAST(cases_1 AS BIGINT) AS cases_1, round(gap_1, 6) AS gap_1, CAST(cases_2 AS BIGINT) AS cases_2, round(gap_2, 6) AS gap_2, round(gap_ci_low, 6) AS gap_ci_low,
CASE WHEN cases < 15 OR groups < 4 OR base IS NULL OR cases_1 < 5 OR cases_2 < 5 OR gap_1 IS NULL OR gap_2 IS NULL THEN 'insufficient' WHEN rate - base >= 0.10 AND (CASE WHEN base < 0.01 THEN rate >= 0.10 ELSE rate / base >= 1.5 END) AND round(gap_1, 3) >= 0.03 AND round(gap_2, 3) >= 0.03 AND coalesce(gap_ci_low, 0) > 0 THEN 'holds' ELSE 'not_holds' END AS verdict FROM o)"""


SCOPES = ("same_actor", "target", "others_same_place")


@query(" UNION ALL ".join(map(_scope_sql, SCOPES)))
def after_then_scopes(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    targets = relations.reply_edges(relations.with_reply_to(e)).select(F.col("event_id").alias("id"), F.col("dst").alias("target"))
    out = None
    for scope in SCOPES:
        cases = claims.after_then_cases(e, F.col("kind") == "click", F.col("kind") == "purchase", WIDTH, scope, targets)
        one = claims.after_then(cases).withColumn("scope", F.lit(scope)).withColumn("verdict", claims.after_then_verdict())
        out = one if out is None else out.unionByName(one)
    names = ["scope", "cases", "unpaired", "silent", "groups", "rate", "base", "cases_1", "gap_1", "cases_2", "gap_2", "gap_ci_low", "verdict"]
    return R6(out.select(names), "rate", "base", "gap_1", "gap_2", "gap_ci_low")


def _half_sql(name: str, where: str) -> str:
    return f"count_if({where} AND a) AS a_actors{name}, count_if({where} AND b) AS b_actors{name}, count_if({where} AND a AND b) AS both{name}, count_if({where} AND a AND b) / nullif(count_if({where} AND a), 0) AS share{name}, count_if({where} AND b) / nullif(count_if({where}), 0) AS base{name}"


CO_LONGS = tuple(f"{c}{h}" for h in ("", "_1", "_2") for c in ("a_actors", "b_actors", "n_both"))


@query(f"""WITH EV , o AS (SELECT actor, bool_or(kind = 'purchase' AND value > 50) AS a, bool_or(kind = 'error' AND value > 60) AS b, ('0x' || substr(md5(actor::VARCHAR), 32, 1))::INTEGER % 2 AS h FROM ev GROUP BY actor), x AS (SELECT {_half_sql('', 'true')}, {_half_sql('_1', 'h = 0')}, {_half_sql('_2', 'h = 1')} FROM o)
SELECT * REPLACE ({', '.join(f"round({c}{h}, 6) AS {c}{h}" for h in ('', '_1', '_2') for c in ('share', 'base'))}), CASE WHEN a_actors < 8 OR b_actors < 8 OR both < 5 OR a_actors_1 < 4 OR a_actors_2 < 4 OR coalesce(base_1, 0) = 0 OR coalesce(base_2, 0) = 0 THEN 'insufficient' WHEN share / base >= 1.5 AND share - base >= 0.1 AND share_1 / base_1 >= 1.2 AND share_2 / base_2 >= 1.2 THEN 'holds' ELSE 'not_holds' END AS verdict FROM x""".replace("both <", "n_both <").replace(" AS both", " AS n_both"), longs=CO_LONGS)
def co_occurs_lift(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    out = claims.co_occurrence(e, (F.col("kind") == "purchase") & (F.col("value") > 50), (F.col("kind") == "error") & (F.col("value") > 60))
    out = out.withColumn("verdict", claims.co_occurrence_verdict()).withColumnsRenamed({f"both{h}": f"n_both{h}" for h in ("", "_1", "_2")})
    return R6(out, *[f"{c}{h}" for h in ("", "_1", "_2") for c in ("share", "base")])


@query(f"""WITH EV , {REPLIES}, f AS (SELECT actor, min(t) AS use_t FROM ev WHERE kind = 'purchase' AND value > 50 GROUP BY actor), s AS (SELECT actor, min(t) AS seen_t FROM ev GROUP BY actor), k AS (SELECT x, y, min(t) AS met FROM (SELECT src AS x, dst AS y, t FROM ad UNION ALL SELECT dst, src, t FROM ad) GROUP BY ALL), st AS (SELECT arg_min(actor, (use_t, actor)) AS a, count(*) AS adopters FROM f),
rs AS (SELECT f.* FROM f, st WHERE f.actor <> st.a), l AS (SELECT r.actor, s.actor AS x, r.use_t, EXISTS (SELECT 1 FROM k JOIN f g ON g.actor = k.y WHERE k.x = s.actor AND k.met < r.use_t AND g.use_t < r.use_t) AS linked FROM rs r JOIN s ON s.actor = r.actor OR (s.seen_t < r.use_t AND NOT EXISTS (SELECT 1 FROM f g WHERE g.actor = s.actor AND g.use_t < r.use_t))),
o AS (SELECT actor, bool_or(linked) FILTER (x = actor) AS own, avg(CASE WHEN linked THEN 1.0::DOUBLE ELSE 0 END) FILTER (x <> actor) AS share FROM l GROUP BY actor) SELECT (SELECT adopters FROM st) AS adopters, round(avg(CASE WHEN own THEN 1.0::DOUBLE ELSE 0 END), 6) AS linked, round(avg(share), 6) AS base FROM o""")
def spread_with_base(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    edges = relations.reply_edges(relations.with_reply_to(e))
    return R6(claims.spread(e, edges, (F.col("kind") == "purchase") & (F.col("value") > 50)), "linked", "base")


@query(f"""WITH EV , w AS (SELECT actor, kind AS a, id, k, t + k * {WIDTH} AS lo FROM ev, (VALUES (0), (-4), (-3), (2), (3)) o(k)), s AS (SELECT w.a, w.id, w.k, e.kind AS b FROM w JOIN ev e ON e.actor = w.actor AND e.t > w.lo AND e.t <= w.lo + {WIDTH} GROUP BY ALL), n AS (SELECT kind AS a, count(*) AS n FROM ev GROUP BY 1), bw AS (SELECT a, count(DISTINCT (id, k)) AS bw FROM s WHERE k <> 0 GROUP BY a),
h AS (SELECT a, b, count_if(k = 0) AS responded, count_if(k <> 0) AS bh FROM s WHERE a <> b GROUP BY ALL) SELECT a AS trigger, b AS response, n AS triggers, CAST(responded AS BIGINT) AS responded, round(responded / n, 6) AS rate, round(bh / bw, 6) AS base, round((responded / n) / (bh / bw), 6) AS lift FROM h JOIN n USING (a) JOIN bw USING (a) WHERE bh > 0 AND n >= 10 AND responded >= 5 AND (responded / n) / (bh / bw) >= 0.9""")
def reaction_board(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of kinds in one pass; the bar of the lift, 1.5 by default, is 0.9 here, as the driver's events follow nothing."""
    p = ranges.after_pairs(views.events(spark, sf), WIDTH, off=ranges.OFF)
    rate, base = F.col("followed") / F.col("n_a"), F.col("base_hits") / F.col("base_windows")
    out = p.filter("base_hits > 0 and n_a >= 10 and followed >= 5").withColumn("lift", rate / base).filter("lift >= 0.9")
    return R6(out.select(F.col("a").alias("trigger"), F.col("b").alias("response"), F.col("n_a").alias("triggers"), F.col("followed").alias("responded"), rate.alias("rate"), base.alias("base"), "lift"), "rate", "base", "lift")


@query(f"""WITH EV , {REPLIES}, o AS (SELECT actor, count(*) AS n FROM ev GROUP BY actor), v AS (SELECT 'volume' AS type, actor::VARCHAR AS subject, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS value FROM o QUALIFY value >= 1),
p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count_if(src = least(src, dst)) AS ab, count_if(src <> least(src, dst)) AS ba FROM ad GROUP BY 1, 2), s AS (SELECT 'one sided', a || '-' || b, round(1 - least(ab, ba) / greatest(ab, ba), 6) FROM p WHERE ab + ba >= 3 AND least(ab, ba) <= 0.2 * greatest(ab, ba)),
f AS (SELECT 'fan-out', src::VARCHAR, CAST(count(DISTINCT dst) AS DOUBLE) FROM ad GROUP BY src HAVING count(DISTINCT dst) >= 3), c AS (SELECT channel, kind, count(*) AS k FROM ev GROUP BY ALL), j AS (SELECT *, sum(k) OVER (PARTITION BY channel) AS n, sum(k) OVER (PARTITION BY kind) AS kk, sum(k) OVER () AS nn FROM c),
l AS (SELECT 'outlier', channel || ' ' || kind, round(k / n, 6) FROM j WHERE n >= 8 AND k / n >= greatest(1.5 * (kk - k) / (nn - n), (kk - k) / (nn - n) + 0.1)), u AS (SELECT * FROM v UNION ALL SELECT * FROM s UNION ALL SELECT * FROM f UNION ALL SELECT * FROM l)
SELECT type, subject, value, CAST(row_number() OVER (PARTITION BY type ORDER BY value DESC, subject) AS INTEGER) AS place FROM u QUALIFY place <= 5""")
def signals_board(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors over the whole record, the five strongest of each type."""
    e = views.events(spark, sf)
    edges = relations.reply_edges(relations.with_reply_to(e))
    volume = metrics.volume_rank(e).filter(F.round("z", 6) >= 1).select(F.lit("volume").alias("type"), F.col("actor").cast("string").alias("subject"), F.col("z").alias("value"))
    pairs = relations.reciprocity(edges).filter((F.col("a_to_b") + F.col("b_to_a") >= 3) & (F.least("a_to_b", "b_to_a") <= 0.2 * F.greatest("a_to_b", "b_to_a")))
    sided = pairs.select(F.lit("one sided"), F.concat_ws("-", "a", "b"), 1 - F.col("reciprocity"))
    fan = edges.groupBy("src").agg(F.count_distinct("dst").alias("n")).filter("n >= 3").select(F.lit("fan-out"), F.col("src").cast("string"), F.col("n").cast("double"))
    odd = metrics.outliers(e, "kind", "channel", 8, 1.5, 0.1).select(F.lit("outlier"), F.concat_ws(" ", "channel", "kind"), "share")
    found = R6(volume.union(sided).union(fan).union(odd), "value")
    w = Window.partitionBy("type").orderBy(F.desc("value"), "subject")
    return found.withColumn("place", F.row_number().over(w)).filter("place <= 5")
