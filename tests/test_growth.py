"""Steps whose rows must stay in proportion to their input when one key holds everything."""

from pyspark.sql import functions as F

from tidemark.operators import boards, claims, overlap, ranges, relations


def most_rows(df) -> int:
    """The most rows that any node of the plan gave out; df is run."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append(metric.get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


def _one_place(spark, n=600):
    """n events of n actors in one place, some seconds apart: half of them a, half b."""
    return spark.range(n).select("id", F.col("id").alias("actor"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), F.lit("x").alias("channel"), (F.col("id") * 7 % 1000).alias("t"))


def test_scopes_make_no_pairs(spark):
    e = _one_place(spark)
    cases = claims.after_then_cases(e, F.col("kind") == "a", F.col("kind") == "b", 1000, "others_same_place")
    assert most_rows(cases) <= 5 * 600
    rows = e.collect()
    want = {a.id: any(b.kind == "b" and b.actor != a.actor and a.t < b.t <= a.t + 1000 for b in rows) for a in rows if a.kind == "a"}
    assert {r.id: bool(r.hit) for r in cases.collect()} == want


def test_scopes_of_own_rows_only(spark):
    """The only rows after a case are its own actor's: they don't count in a place; two actors with the same last time do."""
    e = spark.createDataFrame([(1, 1, "a", "x", 10), (2, 1, "b", "x", 20), (3, 2, "a", "y", 10), (4, 2, "b", "y", 20), (5, 3, "b", "y", 20)], "id long, actor long, kind string, channel string, t long")
    got = claims.after_then_cases(e, F.col("kind") == "a", F.col("kind") == "b", 100, "others_same_place").collect()
    assert {r.id: (r.active, r.hit) for r in got} == {1: (False, 0), 3: (True, 1)}


def test_nothing_is_drawn_without_a_gap(spark):
    e = _one_place(spark).withColumn("actor", F.col("id") % 20)
    cases = claims.after_then_cases(e, F.col("kind") == "a", F.col("kind") == "none", 50)
    assert cases.filter("active and base_windows > 0").select("group").distinct().count() >= 8
    assert most_rows(claims.after_then(cases)) < claims.RESAMPLES * 8


def test_makers_make_no_pairs(spark):
    e = _one_place(spark).withColumnRenamed("channel", "artifact")
    said, made = e.filter("kind = 'a'").select("id", "artifact", "t"), e.filter("kind = 'b'").select(F.col("id").alias("maker_id"), "artifact", "t")
    out = boards.latest_makers(said, made, 400, 2)
    assert most_rows(out) <= 5 * 600
    want = set()
    for s in said.collect():
        near = sorted(((m.t, m.maker_id) for m in made.collect() if s.t - 400 <= m.t < s.t), reverse=True)[:2]
        want |= {(s.id, m, k) for k, (_, m) in enumerate(near, 1)}
    assert {tuple(r) for r in out.collect()} == want


def test_overlap_deals_no_pairs(spark):
    sets = spark.range(3000).select((F.col("id") % 300).alias("owner"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(20)).cast("string"))).alias("item"))
    held = {}
    for r in sets.filter("item is not null").collect():
        held.setdefault(r.owner, set()).add(r.item)
    want = {(a, b): len(x & y) / len(x | y) for a, x in held.items() for b, y in held.items() if a < b and len(x & y) / len(x | y) >= 0.55}
    out = overlap.jaccard_pairs(sets, 0.55, 70, 7)
    assert {(r.one, r.two): r.jaccard for r in out.collect()} == want
    assert most_rows(out) <= max(3000, len(want))


def test_shipped_counts_orders_once(spark):
    orders = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 8), (4, None)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame([(1, 5, 30), (1, 5, 20), (2, 5, 40), (3, 5, 10), (4, 6, 1), (4, 6, 2), (4, 6, 3), (9, 5, 1)], "l_orderkey long, l_suppkey long, s long").withColumn("l_shipdate", F.timestamp_seconds("s"))
    out = relations.shipped(orders, lines, 3)
    assert {tuple(r) for r in out.collect()} == {(7, 5, 4, 2, 20), (None, 6, 3, 1, 1)}


def test_pairs_of_labels_make_no_pairs_of_rows(spark):
    e = _one_place(spark).withColumn("actor", F.lit(1))
    out, rows = ranges.after_pairs(e, 1000), e.collect()
    want = {(a, b): (sum(x.kind == a and any(y.kind == b and x.t < y.t <= x.t + 1000 for y in rows) for x in rows), 300) for a, b in ("ab", "ba")}
    assert most_rows(out) <= 5 * 600
    assert {(r.a, r.b): (r.followed, r.n_a) for r in out.collect()} == want


def test_ids_that_come_again_count_once_for_a_window(spark):
    e = spark.createDataFrame([(1, 1, "a", 10), (1, 1, "a", 12), (2, 1, "b", 20)], "id long, actor long, kind string, t long")
    assert {(r.a, r.b, r.followed, r.n_a) for r in ranges.after_pairs(e, 100).collect()} == {("a", "b", 1, 2)}


def test_reaction_in_a_place_makes_no_pairs(spark):
    out = ranges.reaction(_one_place(spark), F.col("kind") == "a", F.col("kind") == "b", 1000, ["channel"], True)
    assert most_rows(out) <= 5 * 600
    assert out.first()["triggers"] == 300
