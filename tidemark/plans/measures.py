"""Queries: metrics with baselines, boards, bursts, statistics, text and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics, reuse, stats
from ..session import table
from ..sources import views
from .registry import query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
WORDS_SQL = "w AS (SELECT id, actor, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM p), sh AS (SELECT id, actor, unnest(list_distinct(list_transform(range(len(ws) - 7), lambda i: array_to_string(ws[i + 1:i + 8], ' ')))) AS shingle FROM w WHERE len(ws) >= 8)"
POSTS_SQL = "p AS (SELECT doc_id AS id, source AS actor, lang AS channel, text FROM documents)"


@query("""WITH EV , o AS (SELECT actor, count(*) AS n, count_if(kind = 'purchase') AS k FROM ev GROUP BY actor), x AS (SELECT *, sum(n) OVER () AS nn, sum(k) OVER () AS kk FROM o)
SELECT actor, n, k, round(k / n, 6) AS rate, round((kk - k) / (nn - n), 6) AS others, round((k / n) / ((kk - k) / (nn - n)), 6) AS lift FROM x""", longs=("k",))
def reply_rate(spark: SparkSession, sf: str) -> DataFrame:
    return R6(metrics.rate_vs_others(views.events(spark, sf), F.col("kind") == "purchase"), "rate", "others", "lift")


@query("""WITH EV , o AS (SELECT actor, count(*) AS n FROM ev GROUP BY actor) SELECT actor, n, rank() OVER (ORDER BY n DESC) AS rank, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS z, (SELECT median(x.n) FROM o x WHERE x.actor <> o.actor) AS median_n FROM o""")
def volume_rank(spark: SparkSession, sf: str) -> DataFrame:
    return R6(metrics.volume_rank(views.events(spark, sf)), "z")


@query("""WITH EV , x AS (SELECT *, t < 1705276800 AS b, t // 3600 AS h FROM ev WHERE t >= 1705276800 - 7 * 86400 AND t < 1705276800 + 7 * 86400),
y AS (SELECT actor, count_if(b) AS n_before, count_if(NOT b) AS n_after, greatest(count(DISTINCT CASE WHEN b THEN h END), 1) AS hours_before, greatest(count(DISTINCT CASE WHEN NOT b THEN h END), 1) AS hours_after FROM x GROUP BY actor)
SELECT *, round(CASE WHEN n_before > 0 THEN n_after / n_before END, 6) AS ratio, round(n_before / hours_before, 6) AS per_hour_before, round(n_after / hours_after, 6) AS per_hour_after FROM y""", longs=("n_before", "n_after"))
def before_after(spark: SparkSession, sf: str) -> DataFrame:
    return R6(metrics.before_after(views.events(spark, sf), 1705276800, 7), "ratio", "per_hour_before", "per_hour_after")


@query("""WITH EV , c AS (SELECT channel AS actor, kind, count(*) AS k FROM ev GROUP BY ALL), j AS (SELECT *, sum(k) OVER (PARTITION BY actor) AS n, sum(k) OVER (PARTITION BY kind) AS kk, sum(k) OVER () AS nn FROM c)
SELECT actor, kind, n, k, round(k / n, 6) AS share, round((kk - k) / (nn - n), 6) AS base FROM j WHERE n >= 8 AND k / n >= greatest(1.5 * (kk - k) / (nn - n), (kk - k) / (nn - n) + 0.1)""", longs=("n",))
def label_shares(spark: SparkSession, sf: str) -> DataFrame:
    e = views.events(spark, sf).withColumn("actor", F.col("channel"))
    out = metrics.outliers(e, least=8, factor=1.5, margin=0.1)
    return R6(out, "share", "base")


@query("WITH EV SELECT kind, count(*) AS n, count(DISTINCT actor) AS actors, round(count(*) / (SELECT count(*) FROM ev), 6) AS share, count(*) / (SELECT count(*) FROM ev) >= 0.15 AS dominant FROM ev GROUP BY kind")
def dominant_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return R6(metrics.dominant(views.events(spark, sf)), "share")


@query("""WITH EV , c AS (SELECT t // 86400 AS period, kind, count(*) AS n FROM ev GROUP BY ALL), j AS (SELECT *, sum(n) OVER (PARTITION BY period) AS v, sum(n) OVER (PARTITION BY kind) AS k, sum(n) OVER () AS vv FROM c)
SELECT period, kind, n, round((n / v) / (k / vv), 6) AS lift, round((n / v) / (k / vv) * ln(1 + n), 6) AS score FROM j WHERE (n / v) / (k / vv) >= 1.1 AND n >= 8""")
def distinctive_periods(spark: SparkSession, sf: str) -> DataFrame:
    return R6(metrics.distinctive(views.events(spark, sf), F.floor(F.col("t") / 86400), lift=1.1), "lift", "score")


@query("""WITH EV , d AS (SELECT actor, t // 86400 AS day, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT *, (sum(n) OVER w - n) / nullif(max(day) OVER w - min(day) OVER w, 0) AS mean_other FROM d WINDOW w AS (PARTITION BY actor))
SELECT actor, day, n, round(mean_other, 6) AS mean_other, round(greatest(0, 1 - list_sum(list_transform(range(n), lambda i: exp(-mean_other + i * ln(mean_other) - lgamma(i + 1))))), 9) AS tail FROM m
WHERE mean_other > 0 AND n >= 2 * mean_other AND 1 - list_sum(list_transform(range(n), lambda i: exp(-mean_other + i * ln(mean_other) - lgamma(i + 1)))) < 0.01""")
def daily_bursts(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.daily_bursts(views.events(spark, sf), ["actor"], 2.0, 0.01)
    return R6(out, "mean_other").withColumn("tail", F.round("tail", 9))


@query("""WITH EV , u AS (SELECT kind AS feature, id AS unit, actor, value AS v, t // 86400 AS bin FROM ev), b AS (SELECT bin, count(DISTINCT unit) AS units, count(DISTINCT actor) AS actors FROM u GROUP BY bin), s AS (SELECT feature, bin, sum(v) AS total FROM u GROUP BY ALL),
c AS (SELECT unnest(range(min(bin), max(bin) + 1)) AS bin FROM u), g AS (SELECT * FROM (SELECT DISTINCT feature FROM u), c)
SELECT feature, bin, coalesce(units, 0) AS units, coalesce(actors, 0) AS actors, round(CASE WHEN units > 0 THEN coalesce(total, 0) / units END, 6) AS rate FROM g LEFT JOIN b USING (bin) LEFT JOIN s USING (feature, bin)""")
def profile_bins(spark: SparkSession, sf: str) -> DataFrame:
    u = views.events(spark, sf).select(F.col("kind").alias("feature"), F.col("id").alias("unit"), "actor", F.col("value").alias("v"), "t")
    return R6(metrics.profile_bins(u, "feature", F.floor(F.col("t") / 86400)), "rate")


@query("""WITH EV , c AS (SELECT actor, count(*) AS n FROM ev GROUP BY actor) SELECT n AS value FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM c) WHERE i = CAST(floor(0.9 * (m - 1)) AS BIGINT)""")
def lower_percentile(spark: SparkSession, sf: str) -> DataFrame:
    n = views.events(spark, sf).groupBy("actor").agg(F.count(F.lit(1)).alias("n"))
    return metrics.lower_percentile(n, "n", 0.9)


@query("""WITH s AS (SELECT source, count(*) AS n, count_if(quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, k, round(greatest(0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS lo, round(least(1, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) AS hi FROM s""", longs=("k",))
def wilson_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    s = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return R6(s.withColumn("lo", low).withColumn("hi", high), "lo", "hi")


@query("""WITH d AS (SELECT quality, toxic, (text LIKE '%***%') AS sym FROM documents JOIN labels USING (doc_id)), c AS (SELECT count_if(sym AND quality = 0) AS a, count_if(sym AND quality <> 0) AS b, count_if(NOT sym AND quality = 0) AS c, count_if(NOT sym AND quality <> 0) AS d, count(*) AS n FROM d)
SELECT a AS both_marked, b AS only_one, c AS only_two, d AS neither, round(((a + d) / n - ((a + b) * (a + c) + (d + b) * (d + c)) / (n * n)) / (1 - ((a + b) * (a + c) + (d + b) * (d + c)) / (n * n)), 6) AS kappa FROM c""", longs=("both_marked", "only_one", "only_two", "neither"))
def judge_kappa(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.contains("text", F.lit("***")).alias("sym")).join(table(spark, sf, "labels"), "doc_id")
    low = F.col("quality") == 0
    c = d.agg(F.count_if(F.col("sym") & low).alias("both_marked"), F.count_if(F.col("sym") & ~low).alias("only_one"), F.count_if(~F.col("sym") & low).alias("only_two"), F.count_if(~F.col("sym") & ~low).alias("neither"))
    return R6(c.withColumn("kappa", stats.kappa(F.col("both_marked"), F.col("only_one"), F.col("only_two"), F.col("neither"))), "kappa")


@query("""WITH d AS (SELECT lang, quality, text LIKE '%***%' AS found FROM documents JOIN labels USING (doc_id)), s AS (SELECT lang, count(*) AS n, count_if(quality = 0) AS pos, count_if(quality = 0 AND found) AS hit, count_if(found) AS found FROM d GROUP BY lang), z AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang)
SELECT round(sum(size / n * hit) / sum(size / n * found), 6) AS precision, round(sum(size / n * hit) / sum(size / n * pos), 6) AS recall, round(sum(size / n * pos), 6) AS estimated FROM s JOIN z USING (lang)""")
def gold_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.contains("text", F.lit("***")).alias("f"))
    d = docs.join(table(spark, sf, "labels"), "doc_id")
    low = F.col("quality") == 0
    s = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("pos"), F.count_if(low & F.col("f")).alias("hit"), F.count_if("f").alias("found"))
    return R6(stats.stratified_estimates(s.join(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "lang")), "precision", "recall", "estimated")


@query("""WITH d AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM d)
SELECT round((sum(rk) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / (count_if(y = 1) * count_if(y = 0)), 6) AS auc, count_if(y = 1) AS positives, count_if(y = 0) AS negatives FROM r""", longs=("positives", "negatives"))
def auc_rank_sum(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return R6(stats.auc(d.withColumn("quality", F.col("quality").cast("long")), "n_chars", "quality"), "auc")


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey * 7919 % 100003) / 100003.0 * (l_orderkey * 7919 % 100003) / 100003.0 * (l_orderkey * 7919 % 100003) / 100003.0 AS p FROM lineitem), r AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS k, count(*) OVER () AS n FROM x), c AS (SELECT max(p) AS cut FROM r WHERE p <= 0.05 * k / n)
SELECT id, p <= cut AS passes FROM r, c""")
def bh_fdr(spark: SparkSession, sf: str) -> DataFrame:
    u = (F.col("l_orderkey") * 7919 % 100003) / 100003.0
    x = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (u * u * u).alias("p"))
    return stats.benjamini_hochberg(x, "p", 0.05).select("id", "passes")


@query("""SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY a, b) AS ra, row_number() OVER (ORDER BY b, a) AS rb FROM (SELECT c_custkey % 97 AS a, c_acctbal AS b FROM customer))""")
def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 97).alias("a"), F.col("c_acctbal").alias("b"))
    return R6(stats.spearman(c, "a", "b"), "rho")


@query(f"""WITH {POSTS_SQL}, {WORDS_SQL}, f AS (SELECT shingle, min((id, actor)) AS f FROM sh GROUP BY shingle)
SELECT f.f[1] AS src, sh.id, count(*) AS n FROM sh JOIN f USING (shingle) WHERE f.f[1] < sh.id AND f.f[2] <> sh.actor GROUP BY 1, 2 HAVING count(*) >= 3""")
def shingle_reuse_edges(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.reuse_edges(views.posts(spark, sf))


@query(f"""WITH {POSTS_SQL}, {WORDS_SQL}, f AS (SELECT shingle, min((id, actor)) AS f FROM sh GROUP BY shingle)
SELECT id, count(*) AS shingles, round(avg(CASE WHEN f.f[1] <> id AND f.f[2] = actor THEN 1 ELSE 0 END), 6) AS own_share, round(avg(CASE WHEN f.f[1] <> id AND f.f[2] <> actor THEN 1 ELSE 0 END), 6) AS copied_share FROM sh JOIN f USING (shingle) GROUP BY id""")
def own_and_copied(spark: SparkSession, sf: str) -> DataFrame:
    return R6(reuse.own_and_copied(views.posts(spark, sf)), "own_share", "copied_share")


@query(f"""WITH {POSTS_SQL}, {WORDS_SQL}, bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM benchmark), b AS (SELECT item_id, unnest(list_distinct(list_transform(range(len(ws) - 7), lambda i: array_to_string(ws[i + 1:i + 8], ' ')))) AS shingle FROM bw WHERE len(ws) >= 8)
SELECT id, item_id, count(*) AS n FROM sh JOIN b USING (shingle) GROUP BY 1, 2""")
def benchmark_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.overlap(views.posts(spark, sf), table(spark, sf, "benchmark"))


@query("""WITH w AS (SELECT doc_id AS id, source AS actor, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z][a-z'']+)', 1))) AS word FROM documents) SELECT word, count(*) AS df, count(DISTINCT actor) AS actors FROM w GROUP BY word""")
def word_df(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.word_frequency(views.posts(spark, sf))


@query("""WITH w AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z][a-z'']+)', 1))) AS word FROM documents), d AS (SELECT word, count(*) AS df FROM w GROUP BY word)
SELECT id, round(avg(ln((SELECT count(*) FROM documents) / df)), 6) AS score FROM w JOIN d USING (word) GROUP BY id ORDER BY score DESC, id LIMIT 40""")
def rare_terms_rank(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.rare_rank(views.posts(spark, sf), 40)


@query("SELECT doc_id AS id, source AS actor FROM documents WHERE (regexp_matches(lower(text), '(^|[^\\pL\\pN])license([^\\pL\\pN]|$)') AND NOT regexp_matches(lower(text), '(^|[^\\pL\\pN])public([^\\pL\\pN]|$)')) OR regexp_matches(lower(text), '(^|[^\\pL\\pN])copyright')")
def full_text_search(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.search(views.posts(spark, sf), "license NOT public OR copyright*").select("id", "actor")


REDACT = "regexp_replace({x}, 'https?://([^\\s/\"''<>)?#\\]]+)[^\\s\"''<>)\\]]*', '[link to \\1]', 'g')"


@query(f"""WITH r AS (SELECT page_id AS id, {REDACT.format(x="html")} AS h FROM pages) SELECT id, length(h) AS n, (length(h) - length(replace(h, '[link to ', ''))) // 9 AS links FROM r""")
def redact_links(spark: SparkSession, sf: str) -> DataFrame:
    h = F.regexp_replace("html", r"https?://([^\s/\"'<>)?#\]]+)[^\s\"'<>)\]]*", "[link to $1]")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), h.alias("h")).select("id", F.length("h").cast("long").alias("n"), F.floor((F.length("h") - F.length(F.replace("h", F.lit("[link to "), F.lit("")))) / 9).alias("links"))


def redact_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = views.posts(spark, sf).select("actor", X.redact(F.col("text")).alias("r"), "text")
    kinds = [F.sum(F.regexp_count("r", F.lit(rf"\[{k} withheld\]"))).alias(k) for k in ("secret", "markup", "command", "email", "address")]
    return p.groupBy("actor").agg(F.count_if(F.col("r") != F.col("text")).alias("changed"), *kinds)


query()(redact_counts)


@query("""SELECT regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n, count_if(contains(url, '?')) AS with_query, count_if(contains(url, '#')) AS with_fragment FROM pages GROUP BY 1""", longs=("with_query", "with_fragment"))
def url_hosts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(X.host(F.col("url")).alias("host"), "url")
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("url", F.lit("?"))).alias("with_query"), F.count_if(F.contains("url", F.lit("#"))).alias("with_fragment"))


@query(f"""WITH p AS (SELECT url, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, '?' || regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT unnest(list_filter(['requested: ' || host, CASE WHEN regexp_matches(q, '{X.CACHE_TAG}') THEN 'request: random tag that defeats caching' END, CASE WHEN regexp_matches(url, '{X.REDIRECT}') THEN 'request: routed through a redirect service' END, CASE WHEN contains(path[2:], '//') THEN 'request: unusual path (doubled slashes)' END], lambda x: x IS NOT NULL)) AS category FROM p) SELECT category, count(*) AS n FROM c GROUP BY category""")
def request_categories(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "pages").select(F.explode(X.url_category(F.col("url"))).alias("category"))
    return c.filter(F.col("category") != "request: query shaped like code injection").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT CASE WHEN regexp_full_match(v, '-?\\d{1,9}') THEN 'number' WHEN regexp_full_match(v, '[A-Za-z]+') THEN 'word' WHEN regexp_full_match(v, '[A-Za-z0-9_.|:/-]+') THEN 'token' ELSE 'other' END AS form FROM (SELECT c_mktsegment AS v FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT c_acctbal::VARCHAR FROM customer UNION ALL SELECT p_type FROM part)) SELECT form, count(*) AS n FROM c GROUP BY form""")
def value_forms(spark: SparkSession, sf: str) -> DataFrame:
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    v = c.select("c_mktsegment").union(c.select("c_name")).union(c.select(F.col("c_acctbal").cast("string"))).union(p.select("p_type")).toDF("v")
    return v.groupBy(X.value_form(F.col("v")).alias("form")).agg(F.count(F.lit(1)).alias("n"))


def _in_sql(pattern: str) -> str:
    """A pattern for RE2: without look-around, quotes doubled."""
    return pattern.replace("(?<!command )", "").replace("'", "''")


@query(f"""SELECT source, {', '.join(f"count_if(regexp_matches(text, '{_in_sql(p)}')) AS {name}" for name, p in X.CUES.items())}, count(*) AS n FROM documents GROUP BY source""", longs=tuple(X.CUES))
def cue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.posts(spark, sf).groupBy(F.col("actor").alias("source")).agg(*[F.count_if(X.cue(F.col("text"), name)).alias(name) for name in X.CUES], F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 3000), b AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars < 200)
SELECT source, lang FROM a EXCEPT SELECT source, lang FROM b""")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    pair = lambda c: d.filter(c).select("source", "lang").distinct()
    return pair("n_chars > 3000").join(pair("n_chars < 200"), ["source", "lang"], "left_anti")


def artifact_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Files, links and other artifacts named in texts, with the sources that name them."""
    p = views.posts(spark, sf).select("actor", F.explode(X.artifacts(F.col("text"))).alias("artifact"))
    return p.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("actors"))


query()(artifact_overlap)


@query("""WITH EV , x AS (SELECT kind, value FROM ev) SELECT kind, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS median_value FROM x GROUP BY kind""")
def value_moments(spark: SparkSession, sf: str) -> DataFrame:
    out = views.events(spark, sf).groupBy("kind").agg(F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("sd"), F.percentile("value", F.lit(0.5)).alias("median_value"))
    return R6(out, "mean_value", "sd", "median_value")


