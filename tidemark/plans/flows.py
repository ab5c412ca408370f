"""Queries: flow of features along edges, graphs, vectors, and driver-side models over small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, cluster, flow, influence, sequences
from ..session import cut, table
from ..sources import views
from .measures import R6
from .registry import query

UNITS_SQL = """EV , un AS (SELECT id AS unit, actor, t, (t - 345600) // 604800 AS week FROM ev), has AS (SELECT id AS unit, kind AS feature FROM ev UNION ALL SELECT id, 'high' FROM ev WHERE value > 50),
ed AS (SELECT u AS u, v AS v FROM (SELECT u.id AS u, v.id AS v, row_number() OVER (PARTITION BY v.id ORDER BY u.t DESC, u.id DESC) AS r FROM ev v JOIN ev u ON u.channel = v.channel AND u.actor <> v.actor AND u.t >= v.t - 86400 AND (u.t, u.id) < (v.t, v.id)) WHERE r <= 3)"""
RATIO_SQL = """g AS (SELECT * FROM strata WHERE n1 > 0 AND n0 > 0), z AS (SELECT *, CASE WHEN a = 0 OR a = n1 OR c = 0 OR c = n0 THEN 0.5 ELSE 0.0 END AS f FROM g),
y AS (SELECT {by}, CAST(sum(a) AS BIGINT) AS exposed_with, CAST(sum(n1) AS BIGINT) AS exposed, CAST(sum(c) AS BIGINT) AS unexposed_with, CAST(sum(n0) AS BIGINT) AS unexposed, sum((a + f) * (n0 + 2 * f) / (n1 + n0 + 4 * f)) AS r, sum((c + f) * (n1 + 2 * f) / (n1 + n0 + 4 * f)) AS s,
sum(((a + c + 2 * f) * (n1 + 2 * f) * (n0 + 2 * f) - (a + f) * (c + f) * (n1 + n0 + 4 * f)) / ((n1 + n0 + 4 * f) * (n1 + n0 + 4 * f))) AS p FROM z GROUP BY {by})
SELECT {by}, exposed_with, exposed, unexposed_with, unexposed, round(r / s, 6) AS rr, round(r / s * exp(-1.96 * sqrt(p / (r * s))), 6) AS lo, round(r / s * exp(1.96 * sqrt(p / (r * s))), 6) AS hi FROM y"""
STRATA_SQL = "tg AS (SELECT DISTINCT v FROM ed), ex AS (SELECT DISTINCT v, feature FROM ed JOIN has ON has.unit = ed.u), gr AS (SELECT tg.v, un.week, f.feature FROM tg JOIN un ON un.unit = tg.v, (SELECT DISTINCT feature FROM has) f), st AS (SELECT gr.*, ex.v IS NOT NULL AS e, h.unit IS NOT NULL AS h FROM gr LEFT JOIN ex USING (v, feature) LEFT JOIN (SELECT DISTINCT unit, feature FROM has) h ON h.unit = gr.v AND h.feature = gr.feature), strata AS (SELECT feature, week, count_if(e AND h) AS a, count_if(e) AS n1, count_if(NOT e AND h) AS c, count_if(NOT e) AS n0 FROM st GROUP BY ALL)"


def _flow(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = views.events(spark, sf)
    has = e.select(F.col("id").alias("unit"), F.col("kind").alias("feature")).union(e.filter("value > 50").select("id", F.lit("high")))
    return e.select(F.col("id").alias("unit"), "actor", "t"), has, cut(sequences.previous_others(e, "channel", 3, 86400).select("u", "v"))


def _week() -> Column:
    return flow.week_of(F.col("t"))


@query(f"""WITH {UNITS_SQL}, n AS (SELECT t // 86400 AS bin, count(*) AS n FROM un GROUP BY 1), k AS (SELECT feature, t // 86400 AS bin, count(*) AS k FROM has JOIN un USING (unit) GROUP BY ALL),
fa AS (SELECT feature, bin, count(*) AS new_actors FROM (SELECT feature, actor, min(t // 86400) AS bin FROM has JOIN un USING (unit) GROUP BY ALL) GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT feature FROM has), n)
SELECT feature, bin, n, coalesce(k, 0) AS k, round(coalesce(k, 0) / n, 6) AS p, round(greatest(0, (coalesce(k, 0) / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(coalesce(k, 0) / n * (1 - coalesce(k, 0) / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS lo,
round(least(1, (coalesce(k, 0) / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(coalesce(k, 0) / n * (1 - coalesce(k, 0) / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS hi, coalesce(new_actors, 0) AS new_actors FROM g LEFT JOIN k USING (feature, bin) LEFT JOIN fa USING (feature, bin)""")
def flow_state_wilson(spark: SparkSession, sf: str) -> DataFrame:
    units, has, _ = _flow(spark, sf)
    return R6(flow.state(units, has, F.floor(F.col("t") / 86400)), "p", "lo", "hi")


@query(f"WITH {UNITS_SQL}, {STRATA_SQL}, {RATIO_SQL.format(by='feature')}")
def flow_transmission(spark: SparkSession, sf: str) -> DataFrame:
    units, has, edges = _flow(spark, sf)
    return R6(flow.transmission(units, has, edges, _week()), "rr", "lo", "hi")


@query(f"""WITH {UNITS_SQL}, fi AS (SELECT feature, actor, min(t) AS first_t FROM has JOIN un USING (unit) GROUP BY ALL), ex AS (SELECT DISTINCT v AS unit, feature FROM ed JOIN has ON has.unit = ed.u),
st AS (SELECT un.unit, un.week, f.feature, ex.unit IS NOT NULL AS e, h.unit IS NOT NULL AS h FROM un CROSS JOIN (SELECT DISTINCT feature FROM has) f LEFT JOIN fi ON fi.feature = f.feature AND fi.actor = un.actor LEFT JOIN ex ON ex.unit = un.unit AND ex.feature = f.feature LEFT JOIN (SELECT DISTINCT unit, feature FROM has) h ON h.unit = un.unit AND h.feature = f.feature WHERE first_t IS NULL OR un.t <= first_t),
strata AS (SELECT feature, week, count_if(e AND h) AS a, count_if(e) AS n1, count_if(NOT e AND h) AS c, count_if(NOT e) AS n0 FROM st GROUP BY ALL), {RATIO_SQL.format(by='feature')}""")
def flow_adoption(spark: SparkSession, sf: str) -> DataFrame:
    units, has, edges = _flow(spark, sf)
    return R6(flow.adoption(units, has, edges, _week()), "rr", "lo", "hi")


@query(f"""WITH {UNITS_SQL}, tv AS (SELECT DISTINCT ed.v, week FROM ed JOIN un ON un.unit = ed.v), n AS (SELECT week, count(*) AS n FROM tv GROUP BY week), se AS (SELECT DISTINCT ed.v, feature AS a_feature FROM ed JOIN has ON has.unit = ed.u), ow AS (SELECT DISTINCT v, week, feature AS b_feature FROM tv JOIN has ON has.unit = tv.v),
n1 AS (SELECT a_feature, week, count(*) AS n1 FROM se JOIN tv USING (v) GROUP BY ALL), b AS (SELECT b_feature, week, count(*) AS b FROM ow GROUP BY ALL), a AS (SELECT a_feature, b_feature, week, count(*) AS a FROM se JOIN ow USING (v) GROUP BY ALL),
strata AS (SELECT a_feature, b_feature, week, coalesce(a, 0) AS a, n1, b - coalesce(a, 0) AS c, n - n1 AS n0 FROM n1 JOIN b USING (week) JOIN n USING (week) LEFT JOIN a USING (a_feature, b_feature, week) WHERE a_feature <> b_feature), {RATIO_SQL.format(by='a_feature, b_feature')} WHERE exposed_with >= 5 AND r / s * exp(-1.96 * sqrt(p / (r * s))) > 1""")
def flow_coupling(spark: SparkSession, sf: str) -> DataFrame:
    units, has, edges = _flow(spark, sf)
    return R6(flow.coupling(units, has, edges, _week()), "rr", "lo", "hi")


@query(f"""WITH {UNITS_SQL}, w AS (SELECT *, t >= 1705276800 AS late FROM un WHERE t >= 1704672000 AND t < 1705881600), n AS (SELECT count_if(NOT late) AS n0, count_if(late) AS n1 FROM w), k AS (SELECT feature, count_if(NOT late) AS k0, count_if(late) AS k1 FROM has JOIN w USING (unit) GROUP BY feature)
SELECT feature, k0, n0, k1, n1, round((k1 / n1 - k0 / n0) / sqrt((k1 + k0) / (n1 + n0) * (1 - (k1 + k0) / (n1 + n0)) * (1 / n1 + 1 / n0)), 6) AS z FROM k, n""", longs=("k0", "n0", "k1", "n1"))
def flow_shift(spark: SparkSession, sf: str) -> DataFrame:
    units, has, _ = _flow(spark, sf)
    t = F.col("t")
    return R6(flow.shift(units, has, (t >= 1704672000) & (t < 1705276800), (t >= 1705276800) & (t < 1705881600)), "z")


@query(f"""WITH {UNITS_SQL} SELECT h.feature, x.actor, count(*) AS pairs FROM ed JOIN has h ON h.unit = ed.u JOIN has g ON g.unit = ed.v AND g.feature = h.feature JOIN un x ON x.unit = ed.u GROUP BY ALL""")
def flow_spreaders(spark: SparkSession, sf: str) -> DataFrame:
    return flow.spreaders(*_flow(spark, sf))


@query()  # the recursive SQL is too slow on whole tables; tests hold it against brute force
def cascade_components(spark: SparkSession, sf: str) -> DataFrame:
    return flow.cascades(*_flow(spark, sf))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL) SELECT q.vec_id AS q_id, e.vec_id, r.place FROM q, LATERAL (SELECT vec_id, CAST(row_number() OVER (ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9), vec_id) AS INTEGER) AS place FROM embeddings e WHERE e.vec_id <> q.vec_id) r JOIN embeddings e ON e.vec_id = r.vec_id WHERE r.place <= 11""")
def knn_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return cluster.nearest(v, v.filter("vec_id % 100 = 0"), 11)


@query("""WITH x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)), m AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY i) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(greatest(-5, least(5, (v - m) / s)) / sqrt(64.0), 6) AS z FROM x JOIN m USING (i) WHERE s > 1e-9""")
def standardise_block(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return R6(cluster.standardise(v, 64), "z")


@query("""WITH x AS (SELECT label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)), a AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY i), g AS (SELECT label, i, avg(v) AS gm FROM x GROUP BY label, i), z AS (SELECT label, CAST(i - 1 AS INTEGER) AS i, round((gm - m) / s, 6) AS z FROM g JOIN a USING (i))
SELECT label, i, z FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(z) DESC, i) AS r FROM z WHERE abs(z) >= 0.1) WHERE r <= 10""")
def type_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return cluster.contrasts(v, "label", 0.1, 10)


def regimes(spark: SparkSession, sf: str) -> DataFrame:
    units, has, _ = _flow(spark, sf)
    rows = [(r["start_day"], r["end_day"], r["units"]) for r in flow.regimes(units, has)]
    return spark.createDataFrame(rows, "start_day int, end_day int, units int")


def influence_links(spark: SparkSession, sf: str) -> DataFrame:
    """Behaviour to behaviour: the coefficient of having a source that shows g on showing f, with week effects; see operators.influence."""
    units, has, edges = _flow(spark, sf)
    return influence.links(units, has, edges, _week())


def pca_layout(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return cluster.pca(v, 2)


def kmeans_kinds(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return cluster.kinds(v, 8)


def screener_scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return cluster.screener(d.select(F.col("doc_id").alias("id"), F.col("source").alias("actor"), "text", F.col("quality").alias("label")))


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster bootstrap of the share of purchases: 300 resamples of actors by Poisson weights drawn from hashes."""
    e = views.events(spark, sf).groupBy("actor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "purchase").alias("k"))
    return cluster.bootstrap(e, "actor", "k", "n", 300)


def record_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumn("chars", F.length("meta"))
    return chunks.cut_chunks(e, 2000, 4000)


@query("""WITH EV , d AS (SELECT t // 86400 AS day, count(*) AS n, count(DISTINCT actor) AS actors FROM ev GROUP BY 1), f AS (SELECT day, count(*) AS new_actors FROM (SELECT actor, min(t // 86400) AS day FROM ev GROUP BY actor) GROUP BY day)
SELECT day, n, actors, coalesce(new_actors, 0) AS new_actors, n >= greatest(100, 3 * (SELECT median(n) FROM d)) AS spike FROM d LEFT JOIN f USING (day)""")
def calendar_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.calendar(views.events(spark, sf))


for _f in (regimes, influence_links, pca_layout, kmeans_kinds, screener_scores, bootstrap_ci, record_chunks):
    query()(_f)

