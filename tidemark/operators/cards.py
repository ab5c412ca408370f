"""Cards and views of one node, group or period, batches for readers, and small graphs of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, group: the least id reachable over links (a, b) among nodes (id), itself included. Labels fall along links and jump to their label's label; each round is a written table."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    label = cut(nodes.select("id", F.col("id").alias("group")).distinct())
    both = cut(both.join(label.select(F.col("id").alias("a")), "a", "left_semi").join(label.select(F.col("id").alias("b")), "b", "left_semi"))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("group").alias("g")), "b").groupBy(F.col("a").alias("id")).agg(F.min("g").alias("g"))
        low = label.join(near, "id", "left").select("id", F.col("group").alias("was"), F.least("group", F.coalesce("g", "group")).alias("m"))
        new = cut(low.join(label.select(F.col("id").alias("m"), F.col("group").alias("root")), "m").select("id", "was", F.least("m", "root").alias("group")))
        if not new.filter("group <> was").take(1):
            return new.select("id", "group")
        label = new.select("id", "group")


def first_edges(typed: DataFrame, starts: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each (src, dst) of incidents: the first type of `order`, from a source that doesn't start later. typed: type, src, dst; starts: id, t."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("type"))
    s, d = (starts.select(F.col("id").alias(x), F.col("t").alias(f"{x}_t")) for x in ("src", "dst"))
    good = typed.filter("src <> dst").join(s, "src").join(d, "dst").filter("src_t <= dst_t")
    return good.groupBy("src", "dst").agg(F.min_by("type", rank).alias("type"))


def same_actor_edges(incidents: DataFrame) -> DataFrame:
    """Each incident (id, actor, t) with its actor's next one: type, src, dst."""
    w = Window.partitionBy("actor").orderBy("t", "id")
    return incidents.select(F.lit("same actor").alias("type"), "id", F.lead("id").over(w).alias("dst")).filter("dst is not null").withColumnRenamed("id", "src")


def stretch_features(events: DataFrame, unit: str) -> DataFrame:
    """Of each unit: log sizes, span, the share of its commonest kind, and the burstiness of its gaps, (sd - mean) / (sd + mean), null with fewer than two gaps."""
    w = Window.partitionBy(unit).orderBy("t", "id")
    gaps = events.withColumn("gap", F.col("t") - F.lag("t").over(w))
    kinds = events.groupBy(unit, "kind").agg(F.count(F.lit(1)).alias("c")).groupBy(unit).agg((F.max("c") / F.sum("c")).alias("top_share"))
    out = gaps.groupBy(unit).agg(F.log1p(F.count(F.lit(1))).alias("log_events"), F.log1p(F.max("t") - F.min("t")).alias("log_span"), F.count("gap").alias("gaps"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    burst = F.when((F.col("gaps") >= 2) & (F.col("sd") + F.col("mean") > 0), (F.col("sd") - F.col("mean")) / (F.col("sd") + F.col("mean")))
    return out.join(kinds, unit).select(unit, "log_events", "log_span", "top_share", burst.alias("burstiness"))


def batches(items: DataFrame, group: str, limit: int) -> DataFrame:
    """Items (group, place, size) in order, with the batch each falls into: a batch ends where the running size passes a multiple of `limit`."""
    w = Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("batch", F.floor(F.coalesce(F.sum("size").over(w), F.lit(0)) / limit))


def evenly_spaced(events: DataFrame, key: str, k: int) -> DataFrame:
    """Up to k events of each key, evenly spaced in time: of each of k cells the first event of an actor that the cell before doesn't begin with, else its first."""
    w = Window.partitionBy(key).orderBy("t", "id")
    cells = events.withColumn("cell", F.ntile(k).over(w))
    heads = cells.groupBy(key, "cell").agg(F.min_by("actor", F.struct("t", "id")).alias("head"))
    before = heads.withColumn("before", F.lag("head").over(Window.partitionBy(key).orderBy("cell"))).drop("head")
    fresh = F.when(F.col("actor").eqNullSafe(F.col("before")), 1).otherwise(0)
    return cells.join(before, [key, "cell"]).groupBy(key, "cell").agg(F.min_by("id", F.struct(fresh, "t", "id")).alias("id"))


def ends(events: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The first and last rows of each key, for a card: id, place, from_end."""
    up, down = Window.partitionBy(key).orderBy("t", "id"), Window.partitionBy(key).orderBy(F.desc("t"), F.desc("id"))
    out = events.select(key, "id", F.row_number().over(up).alias("place"), F.row_number().over(down).alias("from_end"))
    return out.filter((F.col("place") <= first) | (F.col("from_end") <= last))


def node_view(events: DataFrame, edges: DataFrame, key: str = "actor", top: int = 6) -> DataFrame:
    """Of each actor: events, first and last time, places, its share of all events, and its strongest links in and out, `top` each."""
    total = events.agg(F.count(F.lit(1)).alias("all_n"))
    own = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_distinct("channel").alias("places"))
    out = own.crossJoin(F.broadcast(total)).select(key, "n", "first_t", "last_t", "places", (F.col("n") / F.col("all_n")).alias("share"))  # one row
    for side, other, name in (("src", "dst", "links_out"), ("dst", "src", "links_in")):
        c = edges.groupBy(F.col(side).alias(key), F.col(other).alias("peer")).agg(F.count(F.lit(1)).alias("c"))
        ranked = c.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), "peer"))).filter(F.col("r") <= top)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "peer"))), lambda x: x["peer"].cast("string")), ",")
        out = out.join(ranked.groupBy(key).agg(text.alias(name)), key, "left")
    return out


def concern_board(flags: DataFrame, total: int, share: float = 0.1) -> DataFrame:
    """kind, events, share of all events, dominant: it is on `share` of them or more."""
    n = flags.groupBy("kind").agg(F.count_distinct("event_id").alias("events"))
    return n.withColumn("share", F.col("events") / F.lit(total)).withColumn("dominant", F.col("share") >= share)


def tallies(readings: DataFrame) -> DataFrame:
    """Of each chunk's reading (chunk, json): statements that overstate or are contradicted, instructions broken or ignored, concerns of medium or high confidence."""
    form = "struct<said:array<struct<how:string>>,instructions:array<struct<outcome:string>>,concerns:array<struct<confidence:string>>>"
    r = readings.select("chunk", F.from_json("json", form).alias("r"))

    def count(rows: str, field: str, values: list[str]) -> Column:
        return F.coalesce(F.size(F.filter(F.col(f"r.{rows}"), lambda x: x[field].isin(values))), F.lit(0))

    return r.select("chunk", F.greatest(F.lit(0), count("said", "how", ["overstates", "contradicted"])).alias("said"), F.greatest(F.lit(0), count("instructions", "outcome", ["broke", "ignored"])).alias("instructions"), F.greatest(F.lit(0), count("concerns", "confidence", ["medium", "high"])).alias("concerns"))


def merged_rules(items: DataFrame, periods: DataFrame, keep: int = 12) -> DataFrame:
    """Of each merged rule (rule, id, t): its first time, the period (start, period) in force then, and its first ids."""
    w = Window.partitionBy("rule").orderBy("t", "id")
    ranked = items.withColumn("r", F.row_number().over(w))
    own = ranked.groupBy("rule").agg(F.min("t").alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= keep, F.struct("r", "id")))), lambda x: x["id"].cast("string")), ",").alias("evidence"))
    both = own.select("rule", "t", "evidence", F.lit(None).cast("string").alias("period"), F.lit(1).alias("side")).union(periods.select(F.lit(None), F.col("start"), F.lit(None), F.col("period").cast("string"), F.lit(0)))
    asof = F.last("period", ignorenulls=True).over(Window.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))  # a row for each rule and period
    return both.withColumn("in_force", asof).filter("side = 1").select("rule", "t", "in_force", "evidence")


def unjudged_sources(edges: DataFrame, units: DataFrame, judged: DataFrame) -> DataFrame:
    """The units to judge next: sources (u) of judged targets (v) that aren't judged and don't start later than their target. units: unit, t."""
    targets = edges.join(judged.select(F.col("unit").alias("v")), "v", "left_semi").join(units.select(F.col("unit").alias("v"), F.col("t").alias("tv")), "v")
    open_ = targets.join(units.select(F.col("unit").alias("u"), F.col("t").alias("tu")), "u").filter("tu <= tv").select(F.col("u").alias("unit")).distinct()
    return open_.join(judged.select("unit"), "unit", "left_anti")


def near_centroid(vectors: DataFrame, group: str, k: int) -> DataFrame:
    """For each group the k vectors outside it that are nearest to its centroid: group, vec_id, place. vectors: vec_id, group, v; groups are a short list."""
    long = vectors.select("vec_id", group, F.posexplode("v").alias("i", "x"))
    mean = long.groupBy(group, "i").agg(F.avg("x").alias("m"))
    centre = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    packed = centre.agg(F.map_from_entries(F.collect_list(F.struct(group, "c"))).alias("centres"))  # one row, a vector for each group
    far = lambda v, c: F.round(F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 9)
    pairs = vectors.crossJoin(F.broadcast(packed)).select("vec_id", F.col(group).alias("own"), "v", F.explode("centres").alias(group, "c")).filter(~F.col("own").eqNullSafe(F.col(group)))
    w = Window.partitionBy(group).orderBy("d", "vec_id")
    return pairs.select(group, "vec_id", far("v", "c").alias("d")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(group, "vec_id", "place")


def densities(marks: DataFrame, total: int) -> DataFrame:
    """feature, n, density over all units, bits = -log2 of it."""
    n = marks.groupBy("feature").agg(F.count_distinct("unit").alias("n"))
    d = F.col("n") / F.lit(total)
    return n.select("feature", "n", d.alias("density"), F.when(d > 0, -F.log2(d)).alias("bits"))


def shift_lists(shifts: DataFrame, top: int = 5, z: float = 1.96) -> DataFrame:
    """Of features with a z: those that stand higher and lower in the later window, the `top` of each. shifts: feature, z."""
    s = shifts.filter(F.abs("z") >= z).withColumn("list", F.when(F.col("z") > 0, "higher").otherwise("lower"))
    w = Window.partitionBy("list").orderBy(F.desc(F.abs("z")), "feature")
    return s.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("list", "place", "feature", "z")


def replication(leads: DataFrame, later: DataFrame) -> DataFrame:
    """Leads (a, b, gap) against the same pairs in a later window: pairs, share whose gap keeps its sign, correlation of gaps."""
    both = leads.select("a", "b", F.col("gap").alias("g1")).join(later.select("a", "b", F.col("gap").alias("g2")), ["a", "b"])
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.signum("g1") == F.signum("g2")).cast("int")).alias("same_sign"), F.corr("g1", "g2").alias("correlation"))


def sampled_to_bytes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Every n-th row of each key, n being the least for which the sizes that stay are likely to fit `limit`: keys with more are thinned evenly. rows: key, id, t, size."""
    total = rows.groupBy(key).agg(F.sum("size").alias("total"))
    w = Window.partitionBy(key).orderBy("t", "id")
    step = F.greatest(F.lit(1), F.ceil(F.col("total") / limit))
    return rows.withColumn("place", F.row_number().over(w)).join(total, key).filter((F.col("place") - 1) % step == 0).select(key, "id")


def reciprocal_rates(answers: DataFrame) -> DataFrame:
    """For each src and dst: edges and the share that dst answered. answers: src, dst, event_id, r_id."""
    return answers.groupBy("src", "dst").agg(F.count_distinct("event_id").alias("n"), F.count("r_id").alias("answered"), F.avg(F.col("r_id").isNotNull().cast("int")).alias("rate"))


def placed_by_neighbours(known: DataFrame, links: DataFrame, rounds: int = 4) -> DataFrame:
    """unit, value, round: the known units (unit, value) in round 0; then in each round those that a link (a, b, w), either way, ties to a placed one take the value of the
    strongest tie, ties by the least neighbour."""
    both = links.select("a", "b", "w").union(links.select("b", "a", "w"))
    placed = known.select("unit", "value", F.lit(0).alias("round"))
    for k in range(1, rounds + 1):
        near = both.join(placed.select(F.col("unit").alias("b"), "value"), "b").join(placed.select(F.col("unit").alias("a")), "a", "left_anti")
        new = near.groupBy(F.col("a").alias("unit")).agg(F.min_by("value", F.struct(-F.col("w"), F.col("b"))).alias("value"))
        placed = cut(placed.union(new.select("unit", "value", F.lit(k).alias("round"))))
    return placed


def folded_middle(events: DataFrame, key: str, label: str, most: int = 14) -> DataFrame:
    """The lines of a key for a judge: all if there are `most` at most, else the first and last halves with one line between that counts what is hidden. key, line, text."""
    w, whole = Window.partitionBy(key).orderBy("t", "id"), Window.partitionBy(key)
    half = most // 2
    rows = events.select(key, F.col(label).alias("text"), F.row_number().over(w).alias("line"), F.count(F.lit(1)).over(whole).alias("n"))
    shown = rows.filter((F.col("n") <= most) | (F.col("line") <= half) | (F.col("line") > F.col("n") - (most - half)))
    hidden = rows.filter((F.col("n") > most) & (F.col("line") == half + 1)).withColumn("text", F.format_string("%d hidden", F.col("n") - most))
    return shown.select(key, "line", "text").union(hidden.select(key, "line", "text"))


def hash_chain(stages: DataFrame, key: str) -> DataFrame:
    """key, place, hash of the stages (key, place, payload) of a run: each hash is the SHA-256 of the one before and the payload, so a replay differs from the first stage on
    that differs. A run has a few stages."""
    packed = stages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "payload"))).alias("rows"))
    zero = F.array(F.lit("")).cast("array<string>")
    chain = F.aggregate("rows", zero, lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x["payload"]), 256))))
    hashes = F.arrays_zip(F.col("rows.place").alias("place"), F.expr("slice(chain, 2, size(rows))").alias("hash"))
    return packed.withColumn("chain", chain).select(key, F.explode(hashes).alias("x")).select(key, F.col("x.place").alias("place"), F.col("x.hash").alias("hash"))


def plan_faults(scenes: DataFrame, cites: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """scene, fault: what breaks a plan's rules; no rows if it is sound. scenes: scene, start, end; cites: scene, id; events: id, t.

    backwards: it ends before it starts; no evidence: it cites nothing; too many: more than `most` ids; unknown: an id that no event has; outside: an event that lies
    outside its span.
    """
    known = cites.distinct().join(events.select("id", "t"), "id", "left").join(scenes, "scene")
    n = cites.groupBy("scene").agg(F.count_distinct("id").alias("n"))
    faults = scenes.filter("end < start").select("scene", F.lit("backwards").alias("fault"))
    faults = faults.union(scenes.join(n, "scene", "left_anti").select("scene", F.lit("no evidence"))).union(n.filter(F.col("n") > most).select("scene", F.lit("too many")))
    faults = faults.union(known.filter("t is null").select("scene", F.lit("unknown"))).union(known.filter("t < start or t > end").select("scene", F.lit("outside")))
    return faults.distinct()
