"""Queries: cases against the record, follow-ups, rules, digests, links, and flow beyond single ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import boards, evidence, flow, relations, reuse
from ..session import table
from ..sources import views
from .flows import RATIO_SQL, STRATA_SQL, UNITS_SQL, _flow, _week
from .measures import POSTS_SQL, R6, WORDS_SQL
from .registry import query
from .sequence import REPLIES


@query("""WITH EV , s AS (SELECT id, actor, channel, t FROM ev WHERE kind = 'purchase'), a AS (SELECT id AS aid, actor, channel, t, kind = 'error' AS err FROM ev WHERE kind IN ('error', 'view')),
p AS (SELECT s.id, a.channel = s.channel AS same, a.err, a.t, a.aid FROM s JOIN a ON a.actor = s.actor AND a.t >= s.t - 86400 AND a.t < s.t), g AS (SELECT id, arg_max(err, (t, aid)) FILTER (same) AS related, arg_max(err, (t, aid)) AS last, count_if(same) AS n FROM p GROUP BY id), l AS (SELECT s.id, count(*) AS later FROM s JOIN a ON a.actor = s.actor AND a.channel = s.channel AND a.err AND a.t > s.t AND a.t <= s.t + 43200 GROUP BY s.id),
f AS (SELECT s.id, coalesce(n, 0) > 0 AND coalesce(related, false) AS fr, coalesce(last, false) AS la, coalesce(n, 0) = 0 AS none, coalesce(later, 0) > 0 AS lf FROM s LEFT JOIN g USING (id) LEFT JOIN l USING (id))
SELECT id, array_to_string(list_filter([CASE WHEN fr THEN 'failed_related' END, CASE WHEN NOT fr AND la THEN 'failed_last' END, CASE WHEN none THEN 'no_own_action' END, CASE WHEN lf THEN 'later_failure' END], lambda x: x IS NOT NULL), ',') AS flags FROM f WHERE fr OR la OR none OR lf""")
def claim_cases(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumnRenamed("channel", "artifact")
    actions = e.filter(F.col("kind").isin("error", "view")).select("actor", "artifact", "t", F.col("id").alias("aid"), (F.col("kind") == "error").alias("error"))
    return evidence.claim_cases(e.filter("kind = 'purchase'").select("id", "actor", "artifact", "t"), actions, 86400, 43200)


@query("WITH EV , s AS (SELECT id, actor, t FROM ev WHERE kind = 'purchase'), r AS (SELECT id AS rid, actor, t, kind = 'error' AS err FROM ev WHERE kind IN ('error', 'view')) SELECT s.id, CASE WHEN max(r.t) >= any_value(s.t) - 86400 THEN arg_max(r.err, (r.t, r.rid)) END AS failed FROM s LEFT JOIN r ON r.actor = s.actor AND r.t <= s.t GROUP BY s.id")
def claims_after_failure(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    results = e.filter(F.col("kind").isin("error", "view")).select("actor", "t", F.col("id").alias("rid"), (F.col("kind") == "error").alias("error"))
    return evidence.last_failed(e.filter("kind = 'purchase'").select("id", "actor", "t"), results, 86400)


DOC_WORDS = "w AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z][a-z'']+)', 1))) AS word FROM documents)"


def _doc_words(spark: SparkSession, sf: str) -> DataFrame:
    return views.posts(spark, sf).select("id", "actor", F.array_distinct(X.tokens(F.col("text"))).alias("words"))


@query(f"""WITH {DOC_WORDS}, d AS (SELECT word, count(*) AS df FROM w GROUP BY word), r AS (SELECT DISTINCT doc_id AS rule, doc_id AS t, unnest(list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z][a-z'']+)', 1)))[1:3]) AS word FROM documents WHERE doc_id < 60), u AS (SELECT r.* FROM r LEFT JOIN d USING (word) WHERE coalesce(df, 0) <= 0.25 * (SELECT count(*) FROM documents)), n AS (SELECT rule, count(*) AS usable FROM u GROUP BY rule),
h AS (SELECT w.doc_id AS chunk, u.rule, u.t, count(*) AS hits FROM u JOIN w USING (word) WHERE u.t < w.doc_id AND w.doc_id - u.t <= 1000 GROUP BY ALL), g AS (SELECT h.* FROM h JOIN n USING (rule) WHERE hits >= least(usable, 2)) SELECT chunk, rule, hits FROM g QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY hits DESC, t, rule) <= 8""")
def rules_mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """The first three words, by value, of the first sixty texts stand for the rules, all texts for chunks."""
    d = _doc_words(spark, sf)
    rules = d.filter("id < 60").select(F.col("id").alias("rule"), F.col("id").alias("t"), F.slice(F.array_sort("words"), 1, 3).alias("words"))
    return evidence.keyword_hits(rules, d.select(F.col("id").alias("chunk"), F.col("id").alias("t"), "words"), horizon=1000)


FIRST_WORDS = "f AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '([a-z][a-z'']+)', 1)) AS ws FROM documents)"


@query(f"""WITH {FIRST_WORDS}, p AS (SELECT a.doc_id AS id, b.doc_id AS other, round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))), 6) AS overlap FROM f a JOIN f b ON b.source = a.source AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 100 WHERE len(list_intersect(a.ws, b.ws)) > 0)
SELECT id, other, overlap FROM p WHERE overlap > 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) <= 3""")
def topic_followups(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.followups(_doc_words(spark, sf).withColumn("t", F.col("id")), 100, 0.3)


@query("""WITH RECURSIVE EV , l AS (SELECT actor, row_number() OVER (PARTITION BY actor ORDER BY t, id) AS place, CAST(value AS BIGINT) AS size FROM ev), r AS (SELECT actor, 0::BIGINT AS place, 0::BIGINT AS used, false AS taken FROM (SELECT DISTINCT actor FROM l) UNION ALL SELECT l.actor, l.place, CASE WHEN r.used + l.size <= 200 THEN r.used + l.size ELSE r.used END, r.used + l.size <= 200 FROM r JOIN l ON l.actor = r.actor AND l.place = r.place + 1) SELECT actor, place FROM r WHERE taken""")
def digest_under_budget(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("actor").orderBy("t", "id")
    lines = views.events(spark, sf).select("actor", F.row_number().over(w).cast("long").alias("place"), F.rint("value").cast("long").alias("size"))
    return evidence.digest(lines, "actor", 200)


@query("""WITH EV , n AS (SELECT *, CASE WHEN lag(actor) OVER w = actor AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY channel ORDER BY t, id)), r AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY t, id) AS line FROM n)
SELECT channel, CAST(line AS BIGINT) AS line, line::BIGINT || '. ' || any_value(actor) || ' ' || any_value(kind) || CASE WHEN count(*) > 1 THEN ' x' || count(*) ELSE '' END AS text, arg_min(id, (t, id)) AS first_id, count(*) AS n FROM r GROUP BY channel, line""")
def rendered_lines(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.rendered(views.events(spark, sf), "channel", "kind")


@query("""WITH EV , v AS (SELECT kind AS feature, actor AS unit, avg(value) AS v FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(v, 6) DESC, unit) AS r FROM v), h AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY md5('3:' || unit::VARCHAR), unit) AS h FROM r WHERE r > 8)
SELECT feature, unit, 'top' AS set FROM r WHERE r <= 3 UNION ALL SELECT feature, unit, 'near' FROM r WHERE r > 5 AND r <= 8 UNION ALL SELECT feature, unit, 'random' FROM h WHERE h <= 4""")
def detection_sets(spark: SparkSession, sf: str) -> DataFrame:
    v = views.events(spark, sf).groupBy(F.col("kind").alias("feature"), F.col("actor").alias("unit")).agg(F.round(F.avg("value"), 6).alias("v"))
    return evidence.detection_sets(v, 3, 3, 8, 4)


@query("WITH EV , c AS (SELECT kind AS run, id, t FROM ev WHERE value > 40), l AS (SELECT id FROM ev WHERE value > 70) SELECT run, count(DISTINCT c.id) AS cited, round(avg(CASE WHEN l.id IS NULL THEN 0 ELSE 1 END), 6) AS in_ledger, count(DISTINCT t // 86400) AS days FROM c LEFT JOIN l ON l.id = c.id GROUP BY run")
def citation_use(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    return R6(evidence.citation_use(e.filter("value > 40").select(F.col("kind").alias("run"), "id", "t"), e.filter("value > 70")), "in_ledger")


@query("WITH o AS (SELECT DISTINCT l_returnflag || l_linestatus AS run, l_partkey AS id FROM lineitem WHERE l_quantity > 45), n AS (SELECT run, count(*) AS n FROM o GROUP BY run), b AS (SELECT x.run AS a, y.run AS b, count(*) AS c FROM o x JOIN o y USING (id) WHERE x.run < y.run GROUP BY ALL) SELECT b.a, b.b, round(c / (p.n + q.n - c), 6) AS agreement FROM b JOIN n p ON p.run = b.a JOIN n q ON q.run = b.b")
def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").filter("l_quantity > 45")
    return R6(evidence.run_agreement(li.select(F.concat("l_returnflag", "l_linestatus").alias("run"), F.col("l_partkey").alias("id"))), "agreement")


@query(f"WITH EV , {REPLIES}, m AS (SELECT a.src, a.dst, a.t, a.event_id, min((b.t, b.event_id)) AS x FROM ad a LEFT JOIN ad b ON b.src = a.dst AND b.dst = a.src AND b.t > a.t AND b.t <= a.t + 172800 GROUP BY ALL) SELECT t // 604800 AS period, 'addressed' AS type, src, dst, count(*) AS n, count_if(x[2] IS NOT NULL) AS answered FROM m GROUP BY ALL", longs=("answered",))
def period_graph(spark: SparkSession, sf: str) -> DataFrame:
    edges = relations.answered(relations.reply_edges(relations.with_reply_to(views.events(spark, sf))), 172800)
    return evidence.period_graph(edges.select(F.lit("addressed").alias("type"), "src", "dst", "t", F.col("r_id").alias("answered")), F.floor(F.col("t") / 604800))


@query(f"""WITH EV , {REPLIES}, x AS (SELECT src, dst, event_id, v.value, e.kind FROM ad JOIN ev v ON v.id = ad.event_id JOIN ev e ON e.id = ad.event_id), y AS (SELECT *, [CASE WHEN value > 80 THEN 'moderate' END, CASE WHEN kind = 'click' THEN 'instruct' WHEN kind = 'view' THEN 'follow' WHEN kind = 'signup' THEN 'restore' WHEN kind = 'purchase' THEN 'build_on_others' END] AS tags, CASE event_id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'structural' ELSE 'note' END AS how FROM x),
z AS (SELECT src, dst, event_id, CASE WHEN list_has_any(tags, ['remove_others', 'moderate']) THEN 'removes' WHEN how = 'explicit' THEN CASE WHEN list_contains(tags, 'instruct') THEN 'instructs' WHEN list_contains(tags, 'follow') THEN 'follows' ELSE 'communicates' END WHEN list_contains(tags, 'restore') THEN 'restores' WHEN list_contains(tags, 'follow') THEN 'follows' WHEN list_contains(tags, 'build_on_others') THEN 'builds_on' WHEN how = 'note' THEN 'responds' END AS type FROM y) SELECT * FROM z WHERE type IS NOT NULL""")
def typed_links(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf)
    edges = relations.reply_edges(relations.with_reply_to(e)).join(e.select(F.col("id").alias("event_id"), "kind", "value"), "event_id")
    act = F.when(F.col("kind") == "click", "instruct").when(F.col("kind") == "view", "follow").when(F.col("kind") == "signup", "restore").when(F.col("kind") == "purchase", "build_on_others")
    tags = F.array_compact(F.array(F.when(F.col("value") > 80, "moderate"), act))
    how = F.when(F.col("event_id") % 3 == 0, "explicit").when(F.col("event_id") % 3 == 1, "structural").otherwise("note")
    return evidence.strongest(edges.select("src", "dst", "event_id", evidence.link_type(tags, how).alias("type")))


@query(f"""WITH c AS (SELECT CASE role WHEN 'assistant' THEN 'message' WHEN 'system' THEN 'self_report' ELSE 'reasoning' END AS kind, text FROM conversations), b AS (SELECT unnest(list_filter([CASE WHEN kind = 'message' THEN 'said' END, CASE WHEN kind = 'self_report' THEN 'self-report' END, CASE WHEN kind IN ('message', 'self_report') AND regexp_matches(text, '{X.CLAIM.replace("'", "''")}') AND (kind = 'self_report' OR regexp_matches(text, '{X.FIRST_PERSON.replace("'", "''")}')) THEN 'claims an outcome' END,
CASE WHEN kind = 'message' AND regexp_matches(text, '{X.CORRECTION.replace("'", "''")}') THEN 'corrects or retracts' END, CASE WHEN kind = 'message' AND regexp_matches(text, '{X.EMAIL}') THEN 'e-mail' END, CASE WHEN kind = 'reasoning' THEN 'thought' END, CASE WHEN kind = 'reasoning' AND regexp_matches(text, '{X.DOUBT.replace("'", "''")}') THEN 'thought: doubts its work' END], lambda x: x IS NOT NULL)) AS behaviour FROM c) SELECT behaviour, count(*) AS n FROM b GROUP BY behaviour""")
def behaviour_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "message").when(F.col("role") == "system", "self_report").otherwise("reasoning")
    c = table(spark, sf, "conversations").select(kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    found = c.select(F.explode(evidence.behaviours(F.col("kind"), F.col("text"), F.lit(None).cast("string"), F.lit(False))).alias("b"))
    skip = F.col("b").isin("posts a phone number", "thought: concealment or evasion words")  # their patterns have no form in the other engine's dialect
    return found.filter(~skip).select(F.when(F.col("b").contains("e-mail"), "e-mail").otherwise(F.col("b")).alias("behaviour")).groupBy("behaviour").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT page_id AS id, regexp_extract(url, '(https?://[^\\s"''<>)\\]]+)', 1) AS url FROM pages), b AS (SELECT id, url, regexp_replace(url, '[?#].*$', '') AS bare FROM p), h AS (SELECT *, regexp_extract(bare, '^https?://([^/]*)', 1) AS host, regexp_replace(bare, '^https?://[^/]*', '') AS path, regexp_replace(regexp_replace(bare, '^https?://[^/]*', ''), '/+$', '') AS short, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM b)
SELECT id, concat_ws('|', '', host, CASE WHEN len(string_split(short, '/')) > 2 THEN regexp_replace(short, '/[^/]*$', '') || '/*' ELSE path END, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(q, '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''))), ',')) AS shape FROM h""")
def page_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), evidence.shape(F.col("url")).alias("shape"))


@query("WITH EV , x AS (SELECT CASE kind WHEN 'click' THEN 'action' WHEN 'view' THEN 'read' WHEN 'signup' THEN 'message' WHEN 'error' THEN 'result' ELSE 'other' END AS kind, CASE WHEN value > 50 THEN 'delete' END AS et, CASE WHEN value < 10 THEN true WHEN value < 20 THEN false END AS created FROM ev) SELECT CASE WHEN kind = 'action' AND et = 'delete' THEN 'removed' WHEN kind = 'message' AND created IS NOT NULL THEN CASE WHEN created THEN 'created' ELSE 'edited' END WHEN kind = 'message' THEN 'posted' WHEN kind = 'action' THEN 'did' WHEN kind = 'result' THEN 'got back' WHEN kind = 'read' THEN 'read' ELSE kind END AS verb, count(*) AS n FROM x GROUP BY 1")
def verbs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("kind") == "click", "action").when(F.col("kind") == "view", "read").when(F.col("kind") == "signup", "message").when(F.col("kind") == "error", "result").otherwise("other")
    v = evidence.verb(kind, F.when(F.col("value") > 50, "delete"), F.when(F.col("value") < 10, True).when(F.col("value") < 20, False))
    return views.events(spark, sf).groupBy(v.alias("verb")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {POSTS_SQL}, {WORDS_SQL}, f AS (SELECT shingle, min((id, actor)) AS f FROM sh GROUP BY shingle), o AS (SELECT id, avg(CASE WHEN f.f[1] <> id AND f.f[2] = actor THEN 1 ELSE 0 END) AS own, avg(CASE WHEN f.f[1] <> id AND f.f[2] <> actor THEN 1 ELSE 0 END) AS copied FROM sh JOIN f USING (shingle) GROUP BY id),
a AS (SELECT 'copies' AS anchor, id FROM o WHERE copied >= 0.5 UNION ALL SELECT 'repeats_own', id FROM o WHERE own >= 0.5 UNION ALL SELECT 'removes', doc_id FROM documents WHERE n_chars < 100 UNION ALL SELECT 'reposts_removed', doc_id FROM documents WHERE n_chars > 4000) SELECT anchor, count(DISTINCT id) AS n FROM a GROUP BY anchor HAVING count(DISTINCT id) >= 5""")
def anchor_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 100, "delete").alias("event_type"), (F.col("n_chars") > 4000).alias("recreation"))
    return evidence.anchors(reuse.own_and_copied(views.posts(spark, sf)), d.filter("false").select("id"), d, 5)


@query(f"""WITH {UNITS_SQL}, tg AS (SELECT DISTINCT v FROM ed), ex AS (SELECT DISTINCT v, feature FROM ed JOIN has ON has.unit = ed.u), wr AS (SELECT feature, week, count(DISTINCT unit) / max(n) AS rate FROM has JOIN un USING (unit) JOIN (SELECT week, count(*) AS n FROM un GROUP BY week) USING (week) GROUP BY ALL),
x AS (SELECT ex.feature, h.unit IS NOT NULL AS hit, coalesce(rate, 0) AS rate FROM ex JOIN un ON un.unit = ex.v LEFT JOIN wr ON wr.feature = ex.feature AND wr.week = un.week LEFT JOIN (SELECT DISTINCT unit, feature FROM has) h ON h.unit = ex.v AND h.feature = ex.feature) SELECT feature, count_if(hit) AS observed, round(sum(rate), 4) AS expected, round(count_if(hit) / sum(rate), 6) AS o_e FROM x GROUP BY feature""", longs=("observed",))
def flow_observed_expected(spark: SparkSession, sf: str) -> DataFrame:
    units, has, edges = _flow(spark, sf)
    out = flow.observed_expected(units, has, edges, _week())
    return R6(out.withColumn("expected", F.round("expected", 4)), "o_e")


@query(f"WITH {UNITS_SQL}, {STRATA_SQL}, {RATIO_SQL.format(by='feature')} WHERE exposed_with >= 5 AND r / s * exp(-1.96 * sqrt(p / (r * s))) > 0.5".join(["SELECT *, CAST(row_number() OVER (ORDER BY lo DESC, feature) AS INTEGER) AS place FROM (", ")"]))
def flow_ranking(spark: SparkSession, sf: str) -> DataFrame:
    units, has, edges = _flow(spark, sf)
    return flow.ranking(R6(flow.transmission(units, has, edges, _week()), "rr", "lo", "hi"), 5, 0.5)


@query(f"SELECT feature, exposed_with, rr, lo, hi, CASE WHEN exposed_with < 5 OR lo IS NULL THEN 'too few cases' WHEN lo > 1 THEN 'holds' WHEN hi < 1 THEN 'contradicted' ELSE 'undecided' END AS verdict FROM (WITH {UNITS_SQL.replace(') WHERE r <= 3)', ') WHERE r <= 3 AND vt >= 1705276800)').replace('SELECT u.id AS u, v.id AS v,', 'SELECT u.id AS u, v.id AS v, v.t AS vt,')}, {STRATA_SQL}, {RATIO_SQL.format(by='feature')})")
def flow_held_out(spark: SparkSession, sf: str) -> DataFrame:
    units, has, edges = _flow(spark, sf)
    return R6(flow.held_out(units, has, edges, _week(), F.col("t") >= 1705276800), "rr", "lo", "hi")


@query(f"""WITH {UNITS_SQL}, i AS (SELECT unit, t < 1704672000 AS ins FROM un), n AS (SELECT count_if(ins) AS n, count_if(NOT ins) AS m FROM i), k AS (SELECT feature, count_if(ins) AS k, count_if(NOT ins) AS r FROM (SELECT DISTINCT unit, feature FROM has) JOIN i USING (unit) GROUP BY feature),
x AS (SELECT feature, k, round(k / n, 6) AS share, round(r / m, 6) AS elsewhere, (k / n) / ((k + r) / (n + m)) AS l, round((k / n - r / m) / sqrt((k + r) / (n + m) * (1 - (k + r) / (n + m)) * (1 / n + 1 / m)), 6) AS z FROM k, n) SELECT feature, share, elsewhere, round(l, 6) AS lift, z, CAST(row_number() OVER (ORDER BY l DESC, feature) AS INTEGER) AS place FROM x WHERE k >= 5 AND z >= -1 QUALIFY place <= 5""")
def regime_description(spark: SparkSession, sf: str) -> DataFrame:
    units, has, _ = _flow(spark, sf)
    return R6(flow.described(units, has, F.col("t") < 1704672000, 5, -1.0), "share", "elsewhere", "lift", "z")


@query("""WITH EV , s AS (SELECT segment, count(DISTINCT actor) AS actors, sum(n) AS events FROM (SELECT t // 604800 AS segment, actor, count(*) AS n FROM ev GROUP BY ALL) GROUP BY segment), g AS (SELECT unnest(range((SELECT min(t // 604800) - 1 FROM ev), (SELECT max(t // 604800) + 2 FROM ev))) AS segment) SELECT segment, coalesce(actors, 0) AS actors, coalesce(events, 0) AS events FROM g LEFT JOIN s USING (segment)""", longs=("events",))
def segment_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with the actors and events of their nodes, quiet segments included."""
    nodes = views.events(spark, sf).groupBy(F.floor(F.col("t") / 604800).alias("segment"), "actor").agg(F.count(F.lit(1)).alias("n"))
    own = nodes.groupBy("segment").agg(F.count_distinct("actor").alias("actors"), F.sum("n").alias("events"))
    all_ = nodes.agg(F.explode(F.sequence(F.min("segment") - 1, F.max("segment") + 1)).alias("segment"))
    return all_.join(own, "segment", "left").na.fill(0, ["actors", "events"])


@query("WITH EV SELECT e.id, l.quality, l.toxic FROM ev e LEFT JOIN labels l ON l.doc_id = e.id WHERE e.kind = 'click'")
def event_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label row of each event; null without one."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return views.events(spark, sf).filter("kind = 'click'").select("id").join(labels, "id", "left")


@query("SELECT source, list_sort(list_distinct(flatten(list(list_transform(regexp_extract_all(text, '(\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda x: replace(regexp_replace(x, ',+$', ''), ',', ''))))))[1:5] AS numbers FROM documents GROUP BY source".replace("list_sort(list_distinct(flatten(list(", "array_to_string(list_sort(list_distinct(flatten(list(").replace("[1:5] AS numbers", "[1:5], ' ') AS numbers"))
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The first numbers, by value as text, that a source's texts name."""
    n = views.posts(spark, sf).select(F.col("actor").alias("source"), X.number_tokens(F.col("text")).alias("n"))
    return n.groupBy("source").agg(F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("n")))), 1, 5), " ").alias("numbers"))


TERMS = "tk AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\pL\\pN]+)', 1) AS ws FROM documents)"


@query(f"WITH {TERMS} SELECT doc_id AS id, CAST(len(list_filter(ws, lambda x: x = 'license')) AS BIGINT) AS hits FROM tk WHERE list_contains(ws, 'license') AND list_contains(ws, 'the')")
def indexed_words(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.indexed(reuse.text_index(views.posts(spark, sf)), ["license", "the"])


@query(f"WITH {TERMS}, p AS (SELECT doc_id AS id, CAST(len(list_filter(range(1, len(ws)), lambda i: ws[i] = 'of' AND ws[i + 1] = 'the')) AS BIGINT) AS hits FROM tk) SELECT id, hits FROM p WHERE hits > 0")
def indexed_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.indexed(reuse.text_index(views.posts(spark, sf)), ["of", "the"], phrase=True)
