"""Evidence around events: cases of claims against the record, follow-ups, rules mentioned later, digests, links and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Link types, the strongest first; and the verbs of kinds and of typed events.
LINK_TYPES = ["delegates", "returns", "instructs", "removes", "restores", "follows", "builds_on", "communicates", "responds"]
VERBS = {"message": "posted", "action": "did", "result": "got back", "read": "read", "reasoning": "thought", "self_report": "noted", "call": "handed work to", "return": "handed work back"}
EVENT_VERBS = {"delete": "removed", "revert": "reverted", "probe": "requested"}


def verb(kind: Column, event_type: Column, created: Column) -> Column:
    """What an event did. created: null, or whether a message created its page."""
    out = F.when((kind == "action") & event_type.isin(*EVENT_VERBS), F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_VERBS.items() for x in kv]), event_type))
    out = out.when((kind == "message") & created.isNotNull(), F.when(created, "created").otherwise("edited"))
    for k, v in VERBS.items():
        out = out.when(kind == k, F.lit(v))
    return out.otherwise(kind)


def behaviours(kind: Column, text: Column, tool: Column, error: Column) -> Column:
    """The readable behaviours one event shows, in order."""
    said = kind.isin("message", "self_report")
    cue = lambda name: X.cue(text, name)
    mail = text.rlike(X.EMAIL)
    found = [
        F.when(kind == "action", F.coalesce(F.concat(F.lit("acted: "), tool), F.lit("acted"))), F.when((kind == "result") & error, F.concat(F.lit("failed: "), F.coalesce(tool, F.lit("action")))),
        F.when(kind == "message", "said"), F.when(kind == "self_report", "self-report"), F.when(said & cue("claim") & ((kind == "self_report") | cue("first_person")), "claims an outcome"),
        F.when((kind == "message") & cue("correction"), "corrects or retracts"), F.when((kind == "message") & mail & text.rlike(X.PERSONAL_MAIL), "posts a personal e-mail address"),
        F.when((kind == "message") & mail & ~text.rlike(X.PERSONAL_MAIL), "posts an e-mail address"), F.when((kind == "message") & text.rlike(X.PHONE), "posts a phone number"),
        F.when(kind == "read", "read"), F.when(kind == "reasoning", "thought"), F.when((kind == "reasoning") & cue("doubt"), "thought: doubts its work"),
        F.when((kind == "reasoning") & cue("intent"), "thought: concealment or evasion words"), F.when(kind == "call", "delegated work"), F.when(kind == "return", "returned work"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def shape(text: Column) -> Column:
    """The form of an action, for folding repeats: what precedes its first link, host, folder/* and the sorted query keys, with | between; else its start."""
    url = F.regexp_extract(text, r"(https?://[^\s\"'<>)\]]+)", 1)
    bare = F.regexp_replace(url, r"[?#].*$", "")
    host = F.regexp_extract(bare, r"^https?://([^/]*)", 1)
    path = F.regexp_replace(F.regexp_replace(bare, r"^https?://[^/]*", ""), r"/+$", "")
    folder = F.when(F.size(F.split(path, "/")) > 2, F.concat(F.regexp_replace(path, r"/[^/]*$", ""), F.lit("/*"))).otherwise(F.regexp_replace(bare, r"^https?://[^/]*", ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(query, "&"), lambda x: F.element_at(F.split(x, "="), 1)), lambda x: x != "")))
    head = F.substring(F.regexp_extract(text, r"(?s)^(.*?)https?://", 1), 1, 60)
    return F.when(url != "", F.concat_ws("|", head, host, folder, F.array_join(keys, ","))).otherwise(F.substring(text, 1, 300))


def link_type(tags: Column, how: Column) -> Column:
    """The type of a link from its source's tags and how it is known: explicit, structural or note; null if neither says anything."""
    has = lambda *t: F.arrays_overlap(tags, F.array(*map(F.lit, t)))
    explicit = F.when(has("instruct"), "instructs").when(has("follow"), "follows").otherwise("communicates")
    return (
        F.when(has("remove_others", "moderate"), "removes").when(how == "explicit", explicit).when(has("restore"), "restores")
        .when(has("follow"), "follows").when(has("build_on_others"), "builds_on").when(how == "note", "responds")
    )


def strongest(links: DataFrame) -> DataFrame:
    """One type for each (src, dst, event_id): the first of LINK_TYPES."""
    rank = F.array_position(F.array(*map(F.lit, LINK_TYPES)), F.col("type"))
    return links.filter("type is not null").groupBy("src", "dst", "event_id").agg(F.min_by("type", rank).alias("type"))


def claim_cases(statements: DataFrame, actions: DataFrame, before: int = 5400, after: int = 3600) -> DataFrame:
    """Statements (id, actor, artifact, t) whose actor's own record speaks against them: id, flags.

    actions: actor, artifact, t, aid, error. failed_related: the last related action in the `before` seconds failed; failed_last: the actor's last one, related
    or not, did; no_own_action: none is related; later_failure: a related one within `after` seconds failed.
    """
    day = lambda c: F.floor(c / (before + after))
    s = statements.select("id", "actor", F.col("artifact").alias("topic"), F.col("t").alias("st"))
    s = s.withColumn("_b", F.explode(F.array_distinct(F.array(day(F.col("st") - before), day(F.col("st") + after)))))
    joined = s.join(actions.withColumn("_b", day(F.col("t"))), ["actor", "_b"]).filter((F.col("t") >= F.col("st") - before) & (F.col("t") <= F.col("st") + after))
    same, past = F.col("artifact") == F.col("topic"), F.col("t") < F.col("st")
    order = F.struct("t", "aid")
    seen = joined.groupBy("id").agg(
        F.max_by("error", F.when(past & same, order)).alias("related"), F.max_by("error", F.when(past, order)).alias("last"),
        F.count_if(past & same).alias("n_related"), F.count_if(~past & (F.col("t") > F.col("st")) & same & F.col("error")).alias("later"),
    )
    out = statements.select("id").join(seen, "id", "left").na.fill(0, ["n_related", "later"])
    failed = F.coalesce((F.col("n_related") > 0) & F.col("related"), F.lit(False))
    flags = F.array(
        F.when(failed, "failed_related"), F.when(~failed & F.coalesce("last", F.lit(False)), "failed_last"), F.when(F.col("n_related") == 0, "no_own_action"), F.when(F.col("later") > 0, "later_failure")
    )
    return out.select("id", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags")).filter("flags <> ''")


def last_failed(statements: DataFrame, results: DataFrame, within: int) -> DataFrame:
    """id, failed: whether the actor's last result in the `within` seconds before a statement failed (null: none). results: actor, t, rid, error."""
    both = statements.select("actor", "t", "id", F.lit(None).cast("boolean").alias("error"), F.lit(1).alias("side")).union(results.select("actor", "t", F.col("rid"), "error", F.lit(0)))
    w = Window.partitionBy("actor").orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("side") == 0, F.struct("t", "error")), ignorenulls=True).over(w)
    marked = both.withColumn("last", last).filter("side = 1")
    return marked.select("id", F.when(F.col("last.t") >= F.col("t") - within, F.col("last.error")).alias("failed"))


def keyword_hits(rules: DataFrame, chunks: DataFrame, common: float = 0.25, horizon: int = 10, top: int = 8) -> DataFrame:
    """chunk, rule, hits: rules set at most `horizon` before a chunk of which it holds two keywords, or the only usable one; the `top` by hits, then by time.

    rules: rule, t, words (distinct keywords); chunks: chunk, t, words (distinct). A keyword in more than `common` of the chunks isn't usable.
    """
    word = chunks.select("chunk", F.col("t").alias("ct"), F.explode("words").alias("word"))
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    df = word.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    keys = rules.select("rule", "t", F.explode("words").alias("word")).join(df, "word", "left").crossJoin(F.broadcast(n))  # one row
    usable = keys.filter(F.coalesce("df", F.lit(0)) <= common * F.col("n")).select("rule", "t", "word")
    counts = usable.groupBy("rule").agg(F.count(F.lit(1)).alias("usable"))
    hit = usable.join(word, "word").filter((F.col("t") < F.col("ct")) & (F.col("ct") - F.col("t") <= horizon)).groupBy("chunk", "rule", "t").agg(F.count(F.lit(1)).alias("hits"))
    good = hit.join(counts, "rule").filter(F.col("hits") >= F.least(F.col("usable"), F.lit(2)))
    w = Window.partitionBy("chunk").orderBy(F.desc("hits"), "t", "rule")
    return good.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("chunk", "rule", "hits")


def followups(events: DataFrame, within: int, bar: float = 0.08, per: int = 3) -> DataFrame:
    """For each event (id, actor, channel, t, words) its actor's later events on the same topic: id, other, overlap (Jaccard of words above `bar`), the `per` nearest in topic.

    Topics meet by shared words in buckets of time, so events without one in common are never compared.
    """
    b = lambda c: F.floor(F.col(c) / within)
    size = events.select("id", F.size("words").alias("n"))
    flat = events.select("id", "actor", "t", F.explode("words").alias("word"))
    one = flat.select("id", "actor", F.col("t").alias("t1"), "word", F.explode(F.array(b("t"), b("t") + 1)).alias("_b"))
    two = flat.select(F.col("id").alias("other"), "actor", F.col("t").alias("t2"), "word", b("t").alias("_b"))
    met = one.join(two, ["actor", "word", "_b"]).filter((F.col("t2") > F.col("t1")) & (F.col("t2") <= F.col("t1") + within)).groupBy("id", "other").agg(F.count(F.lit(1)).alias("both"))
    sized = met.join(size, "id").join(size.select(F.col("id").alias("other"), F.col("n").alias("m")), "other")
    overlap = F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6)
    w = Window.partitionBy("id").orderBy(F.desc("overlap"), "other")
    return sized.select("id", "other", overlap.alias("overlap")).filter(F.col("overlap") > bar).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per).drop("r")


def digest(lines: DataFrame, key: str, limit: int) -> DataFrame:
    """The lines (key, place, size) that fit a budget of `limit`, in order: one that doesn't fit is left out, and later, smaller ones may still be taken.

    A fold over the sizes of one key; it holds a number for each of its lines.
    """
    packed = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("rows"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))
    fold = F.aggregate("rows", zero, lambda acc, x: F.when(acc["used"] + x["size"] <= limit, F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["taken"], F.array(x["place"].cast("long"))).alias("taken"))).otherwise(acc))
    return packed.select(key, F.explode(fold["taken"]).alias("place"))


def rendered(events: DataFrame, key: str, label: str) -> DataFrame:
    """Numbered lines of a key's record: runs of one actor and label fold into one line. key, line, text, first_id, n."""
    w = Window.partitionBy(key).orderBy("t", "id")
    same = F.lag("actor").over(w).eqNullSafe(F.col("actor")) & F.lag(label).over(w).eqNullSafe(F.col(label))
    run = events.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(key, "line").agg(F.min_by("id", F.struct("t", "id")).alias("first_id"), F.first("actor").alias("actor"), F.first(label).alias("label"), F.count(F.lit(1)).alias("n"))
    times = F.when(F.col("n") > 1, F.concat(F.lit(" x"), F.col("n"))).otherwise("")
    return out.select(key, "line", F.concat("line", F.lit(". "), "actor", F.lit(" "), "label", times).alias("text"), "first_id", "n")


def detection_sets(values: DataFrame, seed: int, top: int = 5, near: int = 15, random: int = 5) -> DataFrame:
    """feature, unit, set: the `top` units by value, of the next ones up to `near` the last `top`, and `random` others by a hash order. values: feature, unit, v."""
    by_v = Window.partitionBy("feature").orderBy(F.desc("v"), "unit")
    ranked = values.withColumn("r", F.row_number().over(by_v))
    first = ranked.filter(F.col("r") <= top).select("feature", "unit", F.lit("top").alias("set"))
    second = ranked.filter((F.col("r") > near - top) & (F.col("r") <= near)).select("feature", "unit", F.lit("near"))
    by_hash = Window.partitionBy("feature").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "unit")), "unit")
    rest = ranked.filter(F.col("r") > near).withColumn("h", F.row_number().over(by_hash)).filter(F.col("h") <= random).select("feature", "unit", F.lit("random"))
    return first.union(second).union(rest)


def lanes(weights: dict[tuple[str, str], float], start: str | None = None) -> list[str]:
    """A greedy chain over the names of a weighted graph of some hundred nodes: always the free node with the strongest tie to the last one, ties by name."""
    names = sorted({x for pair in weights for x in pair})
    tie = {}
    for (a, b), w in weights.items():
        tie[a, b] = tie.get((a, b), 0) + w
        tie[b, a] = tie.get((b, a), 0) + w
    total = {n: sum(w for (a, _), w in tie.items() if a == n) for n in names}
    out, free = [], set(names)
    while free:
        last = out[-1] if out else None
        nxt = start if not out and start in free else min(free, key=lambda n: (-tie.get((last, n), 0), -total[n], n))
        out.append(nxt)
        free.remove(nxt)
    return out


def citation_use(cites: DataFrame, ledger: DataFrame) -> DataFrame:
    """For each run: cited ids, the share that the ledger holds, days they cover. cites: run, id, t; ledger: id."""
    joined = cites.select("run", "id", "t").distinct().join(ledger.select("id").distinct().withColumn("_in", F.lit(1)), "id", "left")
    return joined.groupBy("run").agg(F.count_distinct("id").alias("cited"), F.avg(F.when(F.col("_in").isNotNull(), 1).otherwise(0)).alias("in_ledger"), F.count_distinct(F.floor(F.col("t") / 86400)).alias("days"))


def run_agreement(cites: DataFrame) -> DataFrame:
    """Jaccard similarity of the ids that two runs cite, for every pair of runs that share one. cites: run, id."""
    own = cites.select("run", "id").distinct()
    size = own.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    both = own.withColumnRenamed("run", "a").join(own.withColumnRenamed("run", "b"), "id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    out = both.join(size.select(F.col("run").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("run").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("agreement"))


def period_graph(edges: DataFrame, period: Column) -> DataFrame:
    """period, type, src, dst: n and how many were answered. edges: type, src, dst, t, answered (id or null)."""
    return edges.groupBy(period.alias("period"), "type", "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.count("answered").alias("answered"))


def honest_leads(leads: DataFrame) -> DataFrame:
    """Leads that stand: four actors, three days, a gap of 0.05, both halves above 0, the resampled low end above 0; the safest first."""
    good = (F.col("actors") >= 4) & (F.col("days") >= 3) & (F.col("gap") >= 0.05) & (F.col("gap_1") > 0) & (F.col("gap_2") > 0) & (F.col("low") > 0)
    return leads.filter(good).orderBy(F.desc("low"), "a", "b")


def anchors(texts: DataFrame, mentions: DataFrame, events: DataFrame, least: int = 20) -> DataFrame:
    """anchor, n: features that the record itself measures, with the events that show them, if `least` do. texts: id, own_share, copied_share; mentions: id (names another);
    events: id, event_type, recreation."""
    found = (
        texts.filter("copied_share >= 0.5").select("id", F.lit("copies").alias("anchor")).union(texts.filter("own_share >= 0.5").select("id", F.lit("repeats_own")))
        .union(mentions.select("id", F.lit("names_other"))).union(events.filter("event_type = 'delete'").select("id", F.lit("removes"))).union(events.filter("recreation").select("id", F.lit("reposts_removed")))
    )
    return found.groupBy("anchor").agg(F.count_distinct("id").alias("n")).filter(F.col("n") >= least)
