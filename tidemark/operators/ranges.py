"""What happens after what: interval joins against activity-conditioned baselines, by place, by label pair.

Windows of whole widths are answered from the first and last times of buckets of that width, so no pairs of triggers and responses are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFF = (-4, -3, 2, 3)


def near_windows(cases: DataFrame, rows: DataFrame, keys: list[str], width: int, off: tuple[int, ...], marks: dict[str, Column], others: bool = False) -> DataFrame:
    """cases (keys, t, ta and whatever else) with first_t and last_t of their key's rows, and by each mark an array over off: does (t + k width, t + (k + 1) width] hold a marked
    row of the key, with others of another actor than ta.

    Such a window takes the end of one bucket of width seconds and the start of the next, so the first and last times of buckets decide; with others those of two actors. Rows and
    cases meet in their bucket, dealt by key: nothing grows with the rows of a window.
    """
    kind, none = cases.select(F.struct("*").alias("c")).schema["c"].dataType.simpleString(), F.lit(None)
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    r = rows.filter(known).select(*keys, F.col("t").alias("_t"), F.col("actor").alias("_actor"), F.lit(True).alias("_row"), *[m.alias(f"_m_{x}") for x, m in marks.items()], none.cast(kind).alias("_case"))
    c = cases.select(*keys, F.col("t").alias("_t"), none.alias("_actor"), F.lit(False).alias("_row"), *[F.lit(False).alias(f"_m_{x}") for x in marks], F.struct("*").alias("_case"))
    dealt = r.union(c).repartition(*keys).withColumn("_b", F.floor(F.col("_t") / width))
    span = [f(F.when(F.col("_row"), F.col("_t"))).alias(x) for f, x in ((F.min, "_first"), (F.max, "_last"))]
    packed = F.collect_list("_case").alias("_cases")
    if others:
        ends = [f(F.when(F.col(f"_m_{x}") & F.col("_actor").isNotNull(), F.col("_t"))).alias(f"_{e}_{x}") for x in marks for f, e in ((F.min, "lo"), (F.max, "hi"))]
        own = dealt.groupBy(*keys, "_b", "_actor").agg(*span, *ends, packed)
        w = Window.partitionBy(*keys, "_b")
        for x in marks:
            for f, e in ((F.min, "lo"), (F.max, "hi")):
                own = own.withColumn(f"_{e}1_{x}", f(F.when(F.col(f"_{e}_{x}").isNotNull(), F.struct(F.col(f"_{e}_{x}").alias("t"), F.col("_actor").alias("actor")))).over(w))
        two = []
        for x in marks:
            for f, e in ((F.min, "lo"), (F.max, "hi")):
                first = F.col(f"_{e}1_{x}")
                two += [F.max(first).alias(f"{e}_{x}"), f(F.when(F.col("_actor") != first["actor"], F.col(f"_{e}_{x}"))).alias(f"{e}2_{x}")]
        slots = own.groupBy(*keys, "_b").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), *two, F.flatten(F.collect_list("_cases")).alias("_cases"))
        names = [f"{e}_{x}" for x in marks for e in ("lo", "lo2", "hi", "hi2")]
    else:
        ends = [f(F.when(F.col(f"_m_{x}"), F.col("_t"))).alias(f"{e}_{x}") for x in marks for f, e in ((F.min, "lo"), (F.max, "hi"))]
        slots = dealt.groupBy(*keys, "_b").agg(*span, *ends, packed)
        names = [f"{e}_{x}" for x in marks for e in ("lo", "hi")]
    whole = Window.partitionBy(*keys)
    near = F.collect_list(F.struct("_b", *names)).over(whole.orderBy("_b").rangeBetween(min(off), max(off) + 1))  # a bucket has at most so many neighbours
    spans = slots.select(*keys, "_b", "_cases", near.alias("_near"), F.min("_first").over(whole).alias("first_t"), F.max("_last").over(whole).alias("last_t")).filter(F.size("_cases") > 0)
    flat = spans.select("_b", "_near", "first_t", "last_t", F.explode("_cases").alias("_case"))

    def end(s: Column, e: str, x: str) -> Column:
        return F.when(s[f"{e}_{x}"]["actor"] != F.col("_case")["ta"], s[f"{e}_{x}"]["t"]).otherwise(s[f"{e}2_{x}"]) if others else s[f"{e}_{x}"]

    def held(k: int, x: str) -> Column:
        t = F.col("_case")["t"]
        hit = F.exists("_near", lambda s: ((s["_b"] == F.col("_b") + k) & (end(s, "hi", x) > t + k * width)) | ((s["_b"] == F.col("_b") + k + 1) & (end(s, "lo", x) <= t + (k + 1) * width)))
        known = [F.col("_case")[c].isNotNull() for c in (*keys, *(["ta"] if others else []))]
        for y in known:
            hit = hit & y
        return F.coalesce(hit, F.lit(False))

    return flat.select("_case.*", "first_t", "last_t", *[F.array(*[held(k, x) for k in off]).alias(x) for x in marks])


def reaction(events: DataFrame, trigger: Column, response: Column, width: int, keys: list[str] = ("actor",), others: bool = False, off: tuple[int, ...] = OFF) -> DataFrame:
    """One row: triggers, responded (a response of the key within width seconds after), windows and hits of the baseline.

    The baseline takes windows of the same width shifted by off widths, if the key is active in them at all. With others, activity and responses
    must be another actor's, as for a place key.
    """
    keys, off = list(keys), (0, *off)
    t = events.filter(trigger).select(*keys, F.col("id").alias("tid"), "t", *([] if "actor" in keys else ["actor"])).withColumn("ta", F.col("actor"))
    w = near_windows(t, events, keys, width, off, {"active": F.lit(True), "hit": response}, others)
    own = w.groupBy("tid").agg(*[F.max(F.col(x)[i]).cast("long").alias(f"{x}_{i}") for x in ("active", "hit") for i in range(len(off))])
    added = lambda x: F.coalesce(F.sum(sum(F.col(f"{x}_{i}") for i in range(1, len(off)))), F.lit(0))
    return own.agg(F.count(F.lit(1)).alias("triggers"), F.count_if(F.col("hit_0") > 0).alias("responded"), added("active").alias("base_windows"), added("hit").alias("base_hits"))


def rates(df: DataFrame) -> DataFrame:
    rate, base = F.col("responded") / F.col("triggers"), F.col("base_hits") / F.col("base_windows")
    return df.withColumn("rate", rate).withColumn("base", base).withColumn("lift", F.when(base > 0, rate / base))


def after_pairs(events: DataFrame, width: int, off: tuple[int, ...] = (-3, -2, 2, 3), label: str = "kind", key: str = "actor") -> DataFrame:
    """For all pairs of labels A, B of one key, A other than B: how often B follows A within width, and in shifted windows of active keys."""
    # an id that comes again counts once for each window
    again = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    e = events.select(key, F.col(label).alias("label"), "id", "t", again.alias("again"))
    dealt = e.filter(F.col(key).isNotNull() & F.col("t").isNotNull()).repartition(key).withColumn("_b", F.floor(F.col("t") / width))
    own = dealt.groupBy(key, "_b", "label").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.collect_list(F.struct("id", "t", "again")).alias("rows"))
    slots = own.groupBy(key, "_b").agg(F.collect_list(F.struct("_b", "label", "lo", "hi")).alias("ends"), F.collect_list(F.struct("label", "rows")).alias("own"))
    near = F.flatten(F.collect_list("ends").over(Window.partitionBy(key).orderBy("_b").rangeBetween(min(0, *off), max(0, *off) + 1)))  # labels of a few buckets
    flat = slots.select("_b", near.alias("near"), F.explode("own").alias("o")).select("_b", "near", F.col("o.label").alias("a"), F.explode("o.rows").alias("r"))

    def seen(k: int) -> Column:
        t = F.col("r")["t"]
        held = F.filter("near", lambda s: ((s["_b"] == F.col("_b") + k) & (s["hi"] > t + k * width)) | ((s["_b"] == F.col("_b") + k + 1) & (s["lo"] <= t + (k + 1) * width)))
        return F.array_distinct(F.transform(held, lambda s: s["label"]))

    rows = flat.select("a", F.when(F.col("r.again"), F.col("r.id")).alias("same"), *[seen(k).alias(f"s{k}") for k in (0, *off)])
    each = lambda k: F.transform(f"s{k}", lambda b: F.struct(F.lit(k).alias("k"), F.lit(False).alias("any"), b.alias("b")))
    any_ = lambda k: F.when(F.size(f"s{k}") > 0, F.struct(F.lit(k).alias("k"), F.lit(True).alias("any"), F.lit(None).cast(events.schema[label].dataType).alias("b")))
    found = F.filter(F.concat(*[each(k) for k in (0, *off)], F.array(*[any_(k) for k in off])), lambda x: x.isNotNull())
    counts = rows.select("a", "same", F.explode(found).alias("x")).groupBy("a", "same", "x.k", "x.any", "x.b").agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("same").isNull(), F.col("n")).otherwise(1)
    pairs = counts.groupBy("a", "any", "b").agg(F.sum(F.when(F.col("k") == 0, n).otherwise(0)).alias("followed"), F.sum(F.when(F.col("k") != 0, n).otherwise(0)).alias("base_hits"))
    pairs = pairs.withColumn("base_windows", F.sum(F.when(F.col("any"), F.col("base_hits")).otherwise(0)).over(Window.partitionBy("a"))).filter("not any and a <> b").drop("any")
    totals = events.groupBy(F.col(label).alias("a")).agg(F.count(F.lit(1)).alias("n_a"))
    return pairs.join(totals, "a").select("a", "b", "followed", "base_hits", "n_a", "base_windows")


def contact_spread(events: DataFrame, contacts: DataFrame, uses: Column) -> DataFrame:
    """Adopters by first use: n adopters and how many had contact, either way, with an earlier adopter before. contacts: src, dst, t."""
    first = events.filter(uses).groupBy("actor").agg(F.min("t").alias("first_t"))
    both = contacts.select(F.col("src").alias("x"), F.col("dst").alias("y"), "t").union(contacts.select("dst", "src", "t")).groupBy("x", "y").agg(F.min("t").alias("met"))
    a, b = first.select(F.col("actor").alias("x"), F.col("first_t").alias("tx")), first.select(F.col("actor").alias("y"), F.col("first_t").alias("ty"))
    linked = both.join(a, "x").join(b, "y").filter("ty < tx and met < tx").select("x").distinct()
    return first.join(linked.withColumnRenamed("x", "actor").withColumn("linked", F.lit(1)), "actor", "left").agg(F.count(F.lit(1)).alias("adopters"), F.count("linked").alias("linked"))
