"""Boards over labels, authority, behaviours and judgements: aggregates of flagged events against the whole record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import previous_others

#: The weights of severities and confidences.
SEVERITY_WEIGHT = {"low": 1, "medium": 2, "high": 4, "critical": 6}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.6}


def with_label(events: DataFrame, labels: DataFrame, tag: str | None = None, concern: str | None = None) -> DataFrame:
    """Events that carry a tag (labels: event_id, tag), or a concern of a kind that isn't of low confidence (event_id, kind, confidence)."""
    wanted = labels.filter(F.col("tag") == tag) if concern is None else labels.filter((F.col("kind") == concern) & (F.col("confidence") != "low"))
    return events.join(wanted.select(F.col("event_id").alias("id")).distinct(), "id", "left_semi")


def active_in(dimension: DataFrame, events: DataFrame, key: str, inside: Column) -> DataFrame:
    """Rows of a dimension with n, the events of their key inside a window; those without any don't appear."""
    return dimension.join(events.filter(inside).groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def label_histogram(labels: DataFrame, label: str, per: str = "event_id") -> DataFrame:
    """n of each label of a multi-label column, its share of label occurrences and of labelled events."""
    flat = labels.select(per, F.explode(F.array_distinct(label)).alias("label"))
    total = flat.agg(F.count(F.lit(1)).alias("all_labels"), F.count_distinct(per).alias("all_events"))
    n = flat.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("all_labels")).alias("share_of_labels"), (F.col("n") / F.col("all_events")).alias("share_of_events"))  # one row of totals


def share_to(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each src: n of its edges, the share that goes to chosen (id, and group where given: also the share to the own group)."""
    known = chosen.select(F.col("id").alias("dst"), F.col("group").alias("dst_group"), F.col("chosen"))
    own = chosen.select(F.col("id").alias("src"), F.col("group").alias("src_group"))
    joined = edges.join(known, "dst", "left").join(own, "src", "left")
    same = F.coalesce(F.col("dst_group") == F.col("src_group"), F.lit(False)).cast("int")
    return joined.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("chosen"), F.lit(False)).cast("int")).alias("to_chosen"), F.avg(same).alias("to_own_group"))


def after_authority(flags: DataFrame, acts: DataFrame, on: str, out: str = "after") -> DataFrame:
    """flags (with t and on) with whether an act (on, t) lies strictly before them."""
    first = acts.groupBy(on).agg(F.min("t").alias("_first"))
    return flags.join(first, on, "left").withColumn(out, F.coalesce(F.col("_first") < F.col("t"), F.lit(False))).drop("_first")


def concern_patterns(flags: DataFrame) -> DataFrame:
    """For each kind of flag (event_id, kind, confidence, actor, channel, t, after): events, actors, channels, high, after_authority, busiest day."""
    day = F.floor(F.col("t") / 86400)
    out = flags.groupBy("kind").agg(
        F.count_distinct("event_id").alias("events"), F.count_distinct("actor").alias("actors"), F.count_distinct("channel").alias("channels"),
        F.count_if(F.col("confidence") == "high").alias("high"), F.count_if("after").alias("after_authority"),
    )
    days = flags.groupBy("kind", day.alias("day")).agg(F.count(F.lit(1)).alias("c")).groupBy("kind").agg(F.min_by("day", F.struct(-F.col("c"), F.col("day"))).alias("busiest_day"))
    return out.join(days, "kind")


def concern_score(flags: DataFrame, total: int, severity: DataFrame) -> DataFrame:
    """score of each actor: over kinds, severity * min(1, 5 % / share of events with the kind) * log2(1 + sum of confidences, doubled after authority).

    flags as in concern_patterns; severity (kind, weight) has a row for each kind, 2 where it is missing.
    """
    shares = flags.groupBy("kind").agg((F.count_distinct("event_id") / F.lit(total)).alias("share"))
    weight = F.when(F.col("confidence") == "high", CONFIDENCE_WEIGHT["high"]).otherwise(CONFIDENCE_WEIGHT["medium"]) * F.when(F.col("after"), 2).otherwise(1)
    cell = flags.groupBy("actor", "kind").agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), F.count_if("after").alias("after"))
    joined = cell.join(shares, "kind").join(severity, "kind", "left")
    score = F.coalesce("weight", F.lit(2)) * F.least(F.lit(1.0), 0.05 / F.col("share")) * F.log2(1 + F.col("w"))
    return joined.groupBy("actor").agg(F.sum(score).alias("score"), F.sum("n").alias("flags"), F.sum("after").alias("after_authority"))


def authority_summary(acts: DataFrame, events: DataFrame) -> DataFrame:
    """One row: removers, targets, targets that are active again after the first act on them. acts: src, dst, t."""
    first = acts.groupBy(F.col("dst").alias("actor")).agg(F.min("t").alias("first_t"))
    again = events.select("actor", "t").join(first, "actor").filter("t > first_t").select("actor").distinct()
    counts = acts.agg(F.count_distinct("src").alias("removers"), F.count_distinct("dst").alias("targets"))
    return counts.crossJoin(again.agg(F.count(F.lit(1)).alias("again")))


def behaviour_cube(events: DataFrame, categories: Column, bin_: Column, examples: int = 40) -> DataFrame:
    """actor, category, bin: n, and the first ids by (t, id). Ids are cut while they are gathered, by place in their cell."""
    flat = events.select("actor", F.explode(categories).alias("category"), bin_.alias("bin"), "id", "t")
    w = Window.partitionBy("actor", "category", "bin").orderBy("t", "id")
    ranked = flat.withColumn("r", F.row_number().over(w))
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.struct("r", "id")))), lambda x: x["id"].cast("string"))
    return ranked.groupBy("actor", "category", "bin").agg(F.max("r").cast("long").alias("n"), F.array_join(ids, ",").alias("ids"))


def grain(events: DataFrame, least: int = 20, days: int = 6) -> DataFrame:
    """One row: day if the event-weighted median of actors' active days (with at least `least` events) is `days` or more, else hour."""
    daily = events.groupBy("actor", F.floor(F.col("t") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    own = daily.groupBy("actor").agg(F.count_if(F.col("n") >= least).alias("active"), F.sum("n").alias("events"))
    by = own.groupBy("active").agg(F.sum("events").alias("events"))  # a row for each number of days
    run = by.withColumn("upto", F.sum("events").over(Window.orderBy("active"))).withColumn("total", F.sum("events").over(Window.partitionBy()))
    return run.filter(F.col("upto") * 2 >= F.col("total")).agg(F.min("active").alias("median_days")).select("median_days", F.when(F.col("median_days") >= days, "day").otherwise("hour").alias("grain"))


def lead_profile(events: DataFrame, by: str, share: float = 0.8) -> DataFrame:
    """For each value of by: n, the leading actor where it has `share` of the events or more, else null (pooled)."""
    cell = events.groupBy(by, "actor").agg(F.count(F.lit(1)).alias("c"))
    out = cell.groupBy(by).agg(F.sum("c").alias("n"), F.min_by("actor", F.struct(-F.col("c"), F.col("actor"))).alias("top"), F.max("c").alias("most"))
    return out.select(by, "n", F.when(F.col("most") >= share * F.col("n"), F.col("top")).alias("lead"))


def calendar_buckets(events: DataFrame, share: float = 0.08, slot: int = 10800) -> DataFrame:
    """Buckets of a day, or of slots of a day that has `share` of all events or more: bucket (its first second), n."""
    day = events.groupBy((F.floor(F.col("t") / 86400) * 86400).alias("day")).agg(F.count(F.lit(1)).alias("c"))
    busy = day.crossJoin(day.agg(F.sum("c").alias("total"))).select("day", (F.col("c") >= share * F.col("total")).alias("busy"))
    e = events.withColumn("day", F.floor(F.col("t") / 86400) * 86400).join(busy, "day")
    bucket = F.when(F.col("busy"), F.floor(F.col("t") / slot) * slot).otherwise(F.col("day"))
    return e.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def coverage(cases: DataFrame, checked: DataFrame, period: str, least: float = 0.1) -> DataFrame:
    """For each period: cases, how many of them were checked (id in checked), share, and thin: the share is below `least`."""
    joined = cases.join(checked.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    out = joined.groupBy(period).agg(F.count(F.lit(1)).alias("cases"), F.count("_hit").alias("checked"))
    return out.withColumn("share", F.col("checked") / F.col("cases")).withColumn("thin", F.col("share") < least)


def exposure(typed: DataFrame, types: list[str]) -> DataFrame:
    """The distinct (v, u) of edges (etype, v, u) of some types."""
    return typed.filter(F.col("etype").isin(types)).select("v", "u").distinct()


def edge_lift(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Unit pairs (v, u) behind event pairs (a: earlier, b: later), by members (id, unit, actor, start): other units, other actors, sources that don't start later."""
    one, two = (members.select(F.col("id").alias(x), F.col("unit").alias(y), F.col("actor").alias(f"_{x}"), F.col("start").alias(f"_s{x}")) for x, y in (("a", "u"), ("b", "v")))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.filter("u <> v and _a <> _b and _sa <= _sb").select("v", "u").distinct()


def latest_makers(statements: DataFrame, makes: DataFrame, within: int = 3 * 86400, keep: int = 2) -> DataFrame:
    """For each statement (id, artifact, t): the latest `keep` earlier makes (maker_id, artifact, t) of its artifact within `within` seconds, with place."""
    make = F.struct(F.col("t").alias("made_t"), "maker_id").alias("make")
    made = makes.filter("artifact is not null and t is not null").select("artifact", F.lit(None).cast(statements.schema["id"].dataType).alias("id"), "t", make, F.floor(F.col("t") / within).alias("_b"))
    said = statements.select("artifact", "id", "t", F.lit(None).cast(made.schema["make"].dataType).alias("make"), F.floor(F.col("t") / within).alias("_b"))
    # what a statement asks for is in its bucket of time or among the last makes of the one before, which come along
    place = Window.partitionBy("artifact", "_b")
    last = made.withColumn("_r", F.row_number().over(place.orderBy(F.desc("t"), F.desc("make.maker_id")))).filter(F.col("_r") <= keep).drop("_r").withColumn("_b", F.col("_b") + 1)
    recent = F.collect_list("make").over(place.orderBy("t", "make.maker_id").rowsBetween(1 - keep, 0)).alias("recent")
    known = made.union(last).select("artifact", "id", "t", "make", "_b", recent)
    both = known.union(said.withColumn("recent", F.lit(None).cast(known.schema["recent"].dataType)))
    upto = place.orderBy("t", F.col("make").isNotNull(), "make.maker_id").rowsBetween(Window.unboundedPreceding, 0)  # a time's statements come before its makes
    found = both.withColumn("recent", F.last("recent", ignorenulls=True).over(upto)).filter("make is null")
    found = found.select("id", "t", F.explode("recent").alias("m")).filter(F.col("m.made_t") >= F.col("t") - within)
    w = Window.partitionBy("id").orderBy(F.desc("m.made_t"), F.desc("m.maker_id"))
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).select("id", "m.maker_id", "place")


def first_changes(events: DataFrame, keys: list[str], label: str, ahead: int = 10, share: float = 0.3, skip: int = 10) -> DataFrame:
    """First occurrences of a label in a key's run, `skip` rows in or later, from which on the label has `share` of the next `ahead` rows: keys, label, id, share."""
    w = Window.partitionBy(*keys).orderBy("t", "id")
    own = Window.partitionBy(*keys, label).orderBy("t", "id")
    place = events.select(*keys, label, "id", "t", F.row_number().over(w).alias("i"), F.row_number().over(own).alias("nth"), F.collect_list(label).over(w.rowsBetween(0, ahead - 1)).alias("near"))
    new = place.filter((F.col("nth") == 1) & (F.col("i") > skip))
    part = F.size(F.filter("near", lambda x: x == F.col(label))) / F.size("near")
    return new.select(*keys, label, "id", part.alias("share")).filter(F.col("share") >= share)


def mix_changes(events: DataFrame, keys: list[str], label: str, width: int = 12) -> DataFrame:
    """For each row of a key's run, the total variation between the label mixes of the `width` rows before it and from it on, where both are full."""
    w = Window.partitionBy(*keys).orderBy("t", "id")
    rows = events.select(*keys, "id", F.collect_list(label).over(w.rowsBetween(-width, -1)).alias("a"), F.collect_list(label).over(w.rowsBetween(0, width - 1)).alias("b"))
    full = rows.filter((F.size("a") == width) & (F.size("b") == width))
    count = lambda x, k: F.size(F.filter(x, lambda y: y == k))
    apart = F.aggregate(F.array_union("a", "b"), F.lit(0), lambda acc, k: acc + F.abs(count("a", k) - count("b", k)))
    return full.select(*keys, "id", (apart / (2.0 * width)).alias("distance"))


def started_and_stopped(events: DataFrame, label: str, days: int = 5) -> DataFrame:
    """actor, label: new if the actor was active on `days` days or more before its first use, stopped if on as many after its last; uses on how many active days."""
    day = F.floor(F.col("t") / 86400)
    active = events.select("actor", day.alias("day")).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("actor").orderBy("day")))
    total = active.groupBy("actor").agg(F.max("nth").alias("all_days"))
    used = events.select("actor", label, day.alias("day")).distinct().join(active, ["actor", "day"])
    out = used.groupBy("actor", label).agg(F.min("nth").alias("first"), F.max("nth").alias("last"), F.count(F.lit(1)).alias("used_days")).join(total, "actor")
    return out.select("actor", label, "used_days", (F.col("first") - 1 >= days).alias("new"), (F.col("all_days") - F.col("last") >= days).alias("stopped"))


def before_context(events: DataFrame, place: str, within: int = 3600, keep: int = 3) -> DataFrame:
    """For each event the previous `keep` events of its place by others, within `within` seconds: id, other, nth."""
    return previous_others(events, place, keep, within).select(F.col("v").alias("id"), F.col("u").alias("other"), "nth")


def label_shuffle(events: DataFrame, label: str, seed: int) -> DataFrame:
    """id and the label of another event of the same actor: labels change places within actors, by a hash order."""
    by_time, by_hash = Window.partitionBy("actor").orderBy("t", "id"), Window.partitionBy("actor").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), "id")
    one = events.select("actor", "id", F.row_number().over(by_time).alias("r"))
    two = events.select("actor", label, F.row_number().over(by_hash).alias("r"))
    return one.join(two, ["actor", "r"]).select("id", F.col(label).alias("shuffled"))


def detection(shown: DataFrame) -> DataFrame:
    """For each feature: precision, recall and coverage of picks. shown: feature, set (top, near, random), picked."""
    count = lambda which, picked: F.count_if((F.col("set") == which) & (F.col("picked") if picked else F.lit(True)))
    s = shown.groupBy("feature").agg(count("top", True).alias("tp"), count("top", False).alias("tn"), count("near", True).alias("np"), count("random", True).alias("rp"), count("random", False).alias("rn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return s.select("feature", ratio(F.col("tp"), F.col("tp") + F.col("np")).alias("precision"), ratio(F.col("tp"), F.col("tn")).alias("recall"), ratio(F.col("rp"), F.col("rn")).alias("coverage"))


def activation(marks: DataFrame, shown: DataFrame, judges: int) -> DataFrame:
    """unit, feature, v: the share of the shown lines, over all judges, that are marked. marks: judge, unit, feature, line; shown: unit, line. Zeros don't appear."""
    both = marks.select("judge", "unit", "feature", "line").distinct().join(shown.distinct(), ["unit", "line"])
    size = shown.distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    return both.groupBy("unit", "feature").agg(F.count(F.lit(1)).alias("m")).join(size, "unit").select("unit", "feature", F.round(F.col("m") / (F.col("size") * judges), 4).alias("v"))


def vocabulary(words: DataFrame, least: int = 5, many: int = 20) -> DataFrame:
    """Words of units (unit, actor, channel, word) used in `least` channels and by `least` actors or more; either test applies only if `many` of them have two units or more."""
    def enough(c: str) -> DataFrame:
        return words.groupBy(c).agg(F.count_distinct("unit").alias("n")).agg((F.count_if(F.col("n") >= 2) >= many).alias(f"test_{c}"))

    use = words.groupBy("word").agg(F.count_distinct("channel").alias("channels"), F.count_distinct("actor").alias("actors"))
    tests = enough("channel").crossJoin(enough("actor"))  # one row
    ok = (~F.col("test_channel") | (F.col("channels") >= least)) & (~F.col("test_actor") | (F.col("actors") >= least))
    return use.crossJoin(F.broadcast(tests)).filter(ok).select("word", "channels", "actors")


def cited(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """Citations (doc, line) with the id that the line stands for (lines: doc, line, id); those that name no line are dropped and counted by doc."""
    joined = citations.join(lines, ["doc", "line"], "left")
    return joined.groupBy("doc").agg(F.count_distinct("id").alias("ids"), F.count_if(F.col("id").isNull()).alias("dropped"))


def day_chunks_read(chunks: DataFrame, reads: DataFrame) -> DataFrame:
    """day, chunks, read, usable: all its chunks were read. chunks: chunk, day; reads: chunk."""
    joined = chunks.join(reads.select("chunk").distinct().withColumn("_r", F.lit(1)), "chunk", "left")
    out = joined.groupBy("day").agg(F.count(F.lit(1)).alias("chunks"), F.count("_r").alias("read"))
    return out.withColumn("usable", F.col("read") == F.col("chunks"))


def numbered(names: DataFrame, first: Column, mark: str = "F") -> DataFrame:
    """name and its number, F01 on: those that `first` holds for come first, then by name. One row for each name of a dictionary."""
    w = Window.orderBy(F.when(first, 0).otherwise(1), "name")
    return names.select("name", F.format_string(f"{mark}%02d", F.row_number().over(w)).alias("number"))


def short_names(names: DataFrame, words: int = 4, chars: int = 40) -> DataFrame:
    """id, name, ok: one to `words` words, `chars` characters at most, and the first of its name, whatever its case, by id."""
    w = Window.partitionBy(F.lower("name")).orderBy("id")
    n = F.size(F.split(F.trim("name"), r"\s+"))
    fits = (F.trim("name") != "") & (n <= words) & (F.length("name") <= chars)
    return names.select("id", "name", (fits & (F.row_number().over(w) == 1)).alias("ok"))


def agreed_preferences(votes: DataFrame) -> DataFrame:
    """pair, winner: the side that wins in both orders (votes: pair, swapped, first_wins), else tie."""
    side = F.when(F.col("first_wins") != F.col("swapped"), "a").otherwise("b")
    out = votes.withColumn("side", side).groupBy("pair").agg(F.count_distinct("side").alias("sides"), F.count_distinct("swapped").alias("orders"), F.min("side").alias("side"))
    return out.select("pair", F.when((F.col("sides") == 1) & (F.col("orders") == 2), F.col("side")).otherwise("tie").alias("winner"))


def first_source(cites: DataFrame) -> DataFrame:
    """id, source: that of the step in which an id first appeared (cites: id, step, source; ties by source)."""
    return cites.groupBy("id").agg(F.min_by("source", F.struct("step", "source")).alias("source"))


def reviewed(parts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """story, kept: every part has exactly one verdict, and it is accept. parts: story, part; verdicts: part, verdict."""
    v = verdicts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("verdict").alias("verdict"))
    ok = F.coalesce((F.col("n") == 1) & (F.col("verdict") == "accept"), F.lit(False))
    return parts.join(v, "part", "left").groupBy("story").agg(F.bool_and(ok).alias("kept"))


def also(events: DataFrame, by: str, a: Column, b: Column, cut: float = 0.3) -> DataFrame:
    """For each value of by with A events: n, the share of them that are B too, and its bin: <10%, <cut, rest."""
    out = events.filter(a).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(b, 1).otherwise(0)).alias("share"))
    return out.withColumn("bin", F.when(F.col("share") < 0.1, "<10%").when(F.col("share") < cut, f"<{cut:g}").otherwise("rest"))


def spec_validity(matches: DataFrame, total: int, least: int = 8, low: float = 0.0003, high: float = 0.3) -> DataFrame:
    """spec, n, valid: between max(least, low * total) and high * total matches. matches: spec, id."""
    n = matches.groupBy("spec").agg(F.count_distinct("id").alias("n"))
    return n.withColumn("valid", (F.col("n") >= max(least, low * total)) & (F.col("n") <= high * total))


def live_chunks(members: DataFrame, doers: DataFrame, any_reads: bool) -> DataFrame:
    """The chunks (chunk, id) that hold an event of doers (id); all of them where the record has no reads."""
    return (members.join(doers, "id", "left_semi") if any_reads else members).select("chunk").distinct()


def neighbourhood(events: DataFrame, seeds: DataFrame, by_actor: int = 2, by_place: int = 3) -> DataFrame:
    """Events near seeds (id): parents and children by reply_to, and places within a few rows by actor and by channel. id, reason, distance; the best reason of each, ties by name."""
    place = events.select("id", "actor", "channel", "reply_to", F.row_number().over(Window.partitionBy("actor").orderBy("t", "id")).alias("pa"), F.row_number().over(Window.partitionBy("channel").orderBy("t", "id")).alias("pc"))
    seed = place.join(seeds.select("id").distinct(), "id", "left_semi")
    parents = seed.filter("reply_to is not null").select(F.col("reply_to").alias("id"), F.lit("parent").alias("reason"), F.lit(1).alias("distance"))
    children = place.join(seed.select(F.col("id").alias("reply_to")), "reply_to").select("id", F.lit("child").alias("reason"), F.lit(1).alias("distance"))
    found = parents.join(place.select("id"), "id", "left_semi").union(children)
    for key, at, most, reason in (("actor", "pa", by_actor, "same actor"), ("channel", "pc", by_place, "same place")):
        spread = seed.select(key, F.col(at).alias("_s"), F.explode(F.sequence(F.col(at) - most, F.col(at) + most)).alias(at)).filter(F.col(at) != F.col("_s"))
        found = found.union(place.join(spread, [key, at]).select("id", F.lit(reason).alias("reason"), F.abs(F.col(at) - F.col("_s")).cast("int").alias("distance")))
    best = found.join(seeds.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("distance", "reason")).alias("b"))
    return best.select("id", "b.reason", "b.distance")
