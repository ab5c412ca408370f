"""Selection, grouping, profiles and names over event tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELD = re.compile(r"[A-Za-z0-9_.]+")


class QueryError(ValueError):
    """A request that can't be answered as asked."""


def window(df: DataFrame, since: int | None = None, until: int | None = None, segment: int | None = None) -> DataFrame:
    """Rows with since <= t < until, in the segment if given."""
    if since is not None:
        df = df.filter(F.col("t") >= since)
    if until is not None:
        df = df.filter(F.col("t") < until)
    return df if segment is None else df.filter(F.col("segment_id") == segment)


def meta_field(name: str, column: str = "meta") -> Column:
    if not FIELD.fullmatch(name):
        raise QueryError(f"bad field name {name!r}")
    return F.get_json_object(column, f"$.{name}")


def select_events(df: DataFrame, kind: str | None = None, actor=None, channel: str | None = None, contains: str | None = None, fields: dict | None = None, text_col: str = "text") -> DataFrame:
    """Rows that meet all conditions; a field of None asks for a missing one."""
    if kind is not None:
        df = df.filter(F.col("kind") == kind)
    if actor is not None:
        df = df.filter(F.col("actor") == actor)
    if channel is not None:
        df = df.filter(F.col("channel") == channel)
    for name, value in (fields or {}).items():
        df = df.filter(meta_field(name).isNull() if value is None else meta_field(name) == str(value).lower() if isinstance(value, bool) else meta_field(name) == str(value))
    return df if contains is None else df.filter(F.contains(F.lower(text_col), F.lit(contains.lower())))


def first_rows(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows in order, each with the total number of rows selected."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def group_events(df: DataFrame, by: Column, name: str = "key") -> DataFrame:
    """count, first, last and number of actors for each key."""
    return df.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_distinct("actor").alias("actors"))


def field_profile(df: DataFrame, top: int = 8, many: int = 50, column: str = "meta") -> DataFrame:
    """For each key of a JSON object: rows, distinct values, and its top values as JSON-like text, or (many)."""
    pairs = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "v"))
    counts = pairs.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("field").orderBy(F.desc("n"), F.asc("v"))
    ranked = counts.withColumn("place", F.row_number().over(place))
    whole = counts.groupBy("field").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_values"))
    best = ranked.filter(F.col("place") <= top).groupBy("field").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("vs"))
    shown = F.when(F.col("distinct_values") > many, F.lit("(many)")).otherwise(F.array_join(F.transform("vs", lambda x: x["v"]), ","))
    return whole.join(best, "field").select("field", "n", "distinct_values", shown.alias("top_values"))


def top_per_group(df: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k most frequent items of each group; ties by item."""
    counts = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(item)))).filter(F.col("place") <= k)


def resolve(names: DataFrame, wanted: str, aliases: DataFrame | None = None) -> DataFrame:
    """Candidates of the best kind of match: id, label without case, alias, unique part of a label. names: id, label."""
    low = wanted.lower()
    label = F.lower("label")
    rows = names.select("id", F.when(F.col("id").cast("string") == wanted, 1).when(label == low, 2).when(F.contains(label, F.lit(low)), 4).alias("how"))
    if aliases is not None:
        rows = rows.union(aliases.filter(F.lower("alias") == low).select("id", F.lit(3).alias("how")))
    rows = rows.filter("how is not null").groupBy("id").agg(F.min("how").alias("how"))
    best = rows.agg(F.min("how").alias("best"))
    return rows.join(F.broadcast(best), F.col("how") == F.col("best")).select("id", "how")


def resolve_one(names: DataFrame, wanted: str, aliases: DataFrame | None = None):
    found = resolve(names, wanted, aliases).limit(2).collect()
    if len(found) != 1:
        raise QueryError(f"{wanted!r} is {'ambiguous' if found else 'unknown'}")
    return found[0]["id"]


def aliases(actors: DataFrame, least: int = 2) -> DataFrame:
    """alias, id: lower-cased names that stand for one actor only. actors: id, names array."""
    named = actors.select("id", F.explode("names").alias("n")).select("id", F.lower("n").alias("alias")).filter(F.length("alias") >= least).distinct()
    return named.groupBy("alias").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).filter("c = 1").select("alias", "id")


NESTED = re.compile(r"\([^()]*[+*}][^()]*\)\s*[+*{]|\(\?[^:=!<i]|\\\d")


def safe_pattern(pattern: str, longest: int = 300) -> str:
    """The pattern, if it compiles and repeats no repetition; else QueryError."""
    if len(pattern) > longest or NESTED.search(pattern):
        raise QueryError("pattern is too long or repeats a repetition")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"bad pattern: {e}") from e
    return pattern


def grep(df: DataFrame, patterns: list[str], text_col: str = "text") -> DataFrame:
    """Rows whose text matches any pattern, without case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(text_col).rlike("(?is)" + safe_pattern(p))
    return df.filter(hit)


def clip(text: Column, n: int) -> Column:
    """White space collapsed, cut to n characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n)), F.lit(" …"))).otherwise(flat)


def role_label(role: Column, label: Column) -> Column:
    return F.when(role.isNull() | (role == label), label).otherwise(F.concat(role, F.lit(" ("), label, F.lit(")")))


def meets(op: Column, value: Column, target: Column, high: Column) -> Column:
    """An expectation op on value; unknown stays null."""
    inside = (value >= target) & (value <= high)
    return (
        F.when(op == ">", value > target).when(op == ">=", value >= target).when(op == "<", value < target).when(op == "<=", value <= target)
        .when(op == "==", value == target).when(op == "!=", value != target).when(op == "between", inside).when(op == "outside", ~inside)
    )


def at_least(confidence: Column, least: str) -> Column:
    levels = F.array(*map(F.lit, ("low", "medium", "high")))
    return F.array_position(levels, confidence) >= F.array_position(levels, F.lit(least))


def hash_order(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def hash_half(key: Column) -> Column:
    """0 or 1 by the first byte of the key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 2), 16, 10).cast("long") % 2


def thin(df: DataFrame, k: int, *order: str) -> DataFrame:
    """k rows evenly spaced in the order, ends included (all if there are no more). The order numbers the whole selection."""
    w = Window.orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    steps = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)))
    return numbered.filter((F.col("_n") <= k) | F.array_contains(steps, F.col("_i").cast("long"))).drop("_i", "_n")
