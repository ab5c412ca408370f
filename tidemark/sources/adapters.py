"""Adapters from other record formats to canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequences import asof_backward


def wiki_revisions(revisions: DataFrame) -> DataFrame:
    """Messages of the lines a revision adds, and deletions as actions that reply to the page's last save before them.

    revisions: id long, t, page, actor, body, action (save, delete, revert). The lines are compared with the page's previous body.
    """
    w = Window.partitionBy("page").orderBy("t", "id")
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    saves = revisions.filter("action in ('save', 'revert')").withColumn("old", F.lag("body").over(w))
    added = F.array_join(F.array_except(lines(F.col("body")), lines(F.col("old"))), "\n")
    messages = saves.select("id", "t", "actor", F.lit("message").alias("kind"), added.alias("text"), F.col("page").alias("channel"), F.lit(None).cast("long").alias("reply_to"))
    deletes = asof_backward(revisions.filter("action = 'delete'").select("id", "t", "page", "actor"), saves.select("id", "t", "page"), ["page"], ["id"], allow_equal=False)
    return messages.union(deletes.select("id", "t", "actor", F.lit("action"), F.lit("delete"), "page", "r_id"))


def chat_village(messages: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, with the role most often used by an actor, and the last memory of each actor and ISO week.

    messages: id, t, actor, room, role, text. memories: actor, t, text.
    """
    counts = messages.groupBy("actor", "role").agg(F.count(F.lit(1)).alias("n"))
    role = counts.groupBy("actor").agg(F.max_by("role", F.struct("n", "role")).alias("main_role"))
    events = messages.join(role, "actor").select("id", "t", "actor", F.lit("message").alias("kind"), "text", F.col("room").alias("channel"), "main_role")
    ts = F.timestamp_seconds("t")
    last = memories.groupBy("actor", F.extract(F.lit("YEAROFWEEK"), ts).alias("year"), F.weekofyear(ts).alias("week")).agg(F.max_by("text", "t").alias("text"), F.max("t").alias("t"))
    return events, last


TRANSCRIPT = "id string, agent_id string, message_type string, created_at string, content struct<message: struct<content: array<struct<type: string, thinking: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>>>>"


def agent_transcript(rows: DataFrame) -> DataFrame:
    """Blocks of a transcript as events: reasoning, message, action, result, with call and failure linked by id.

    Record order is the rows' own time, whatever their place in the files; ids that repeat keep the first row.
    """
    first = rows.withColumn("t", F.unix_timestamp(F.try_to_timestamp(F.replace("created_at", F.lit("T"), F.lit(" "))))).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("t", F.col("agent_id")))).filter("_r = 1")
    b = first.select(F.col("id").alias("row_id"), "t", F.col("agent_id").alias("actor"), F.posexplode("content.message.content").alias("part", "b"))
    kind = F.when(F.col("b.type") == "thinking", "reasoning").when(F.col("b.type") == "tool_use", "action").when(F.col("b.type") == "tool_result", "result").otherwise("message")
    e = b.select(F.concat_ws(".", "row_id", "part").alias("id"), "t", "actor", kind.alias("kind"), F.coalesce("b.thinking", "b.text", "b.content", "b.input", F.lit("")).alias("text"), F.col("b.name").alias("tool"), F.coalesce("b.id", "b.tool_use_id").alias("call_id"), F.coalesce("b.is_error", F.lit(False)).alias("error"))
    calls = e.filter("kind = 'action' and call_id is not null").select("call_id", F.col("id").alias("action_id"))
    results = e.filter("kind = 'result' and call_id is not null").groupBy("call_id").agg(F.min("id").alias("result_id"), F.max("error").alias("failed"))
    out = e.join(calls, "call_id", "left").join(results, "call_id", "left")
    return out.select("id", "t", "actor", "kind", "text", "tool", F.when(F.col("kind") == "result", F.col("action_id")).alias("reply_to"), F.when(F.col("kind") == "action", F.col("result_id").isNull()).alias("unanswered"), F.when(F.col("kind") == "action", F.coalesce("failed", F.lit(False))).otherwise(F.col("error")).alias("failed"))


def changes_only(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's previous one, with the time the next change starts."""
    w = Window.partitionBy(key).orderBy("t", "id")
    kept = rows.withColumn("_p", F.lag(value).over(w)).filter(F.col("_p").isNull() | (F.col("_p") != F.col(value))).drop("_p")
    return kept.withColumn("until", F.lead("t").over(w))


def web_captures(captures: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """A request and a result for each capture. captures: id, t, url, status, section. The requester is the `tag` of the query, else the section's unknown."""
    tag = F.regexp_extract("url", r"[?&]tag=([A-Za-z0-9]+)", 1)
    who = F.when(tag != "", tag).otherwise(F.concat(F.lit("unknown:"), F.coalesce("section", F.lit(""))))
    code = F.expr("try_cast(status as int)")
    failed = code.isNull() | (code == 0) | (code >= 400)
    base = captures.select("id", "t", "url", who.alias("actor"), failed.alias("failed"), F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("channel"))
    asked = base.select(F.concat("id", F.lit(".q")).alias("id"), "t", "actor", F.lit("action").alias("kind"), "url", "channel", F.lit(None).cast("string").alias("reply_to"), F.lit(False).alias("failed"))
    got = base.select(F.concat("id", F.lit(".r")).alias("id"), "t", "actor", F.lit("result").alias("kind"), "url", "channel", F.concat("id", F.lit(".q")).alias("reply_to"), "failed")
    return asked.union(got)


def other_boards(posts: DataFrame, known: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dated posts of origins not known yet, and the undated rest. posts: id, origin, actor, when, url, text; links: url, t.

    The time is the first of three forms that parses, else the first time the post's link appears.
    """
    new = posts.join(known.select("origin").distinct(), "origin", "left_anti")
    first = links.groupBy("url").agg(F.min("t").alias("link_t"))
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy HH:mm")
    t = F.coalesce(*[F.unix_timestamp(F.try_to_timestamp("when", F.lit(f))) for f in forms], "link_t")
    dated = new.join(first, "url", "left").withColumn("t", t).drop("link_t")
    return dated.filter("t is not null"), dated.filter("t is null")


def forum(rows: DataFrame) -> DataFrame:
    """Forum rows (id, t, author, subject, body) with recipients named in the subject as `to: a, b`."""
    to = F.regexp_extract_all(F.regexp_extract(F.lower("subject"), r"to:\s*([\w ,-]+)", 1), F.lit(r"([\w-]+)"), F.lit(1))
    return rows.select("id", "t", F.col("author").alias("actor"), F.lit("message").alias("kind"), F.col("body").alias("text"), to.alias("to"))


def judge_answers(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers (judge, label, feature) by unit; labels (label, unit) that aren't known are counted, not kept."""
    joined = answers.join(labels, "label", "left")
    return joined.groupBy("judge").agg(F.count_if(F.col("unit").isNotNull()).alias("kept"), F.count_if(F.col("unit").isNull()).alias("dropped"))


def write_batches(units: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each batch, the units in it under labels: U1, U2, ... units: batch, unit, text. A batch is what one reader is handed."""
    w = Window.partitionBy("batch").orderBy("unit")
    labelled = units.withColumn("label", F.concat(F.lit("U"), F.row_number().over(w)))
    labelled.write.mode("overwrite").partitionBy("batch").json(folder)


def read_answers(answers: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks (judge, batch, feature, unit) from answers (judge, batch, json: a list of {label, feature}) on written batches, and by judge how many were kept and dropped for
    want of such a label. Malformed answers have no marks."""
    marks = answers.select("judge", "batch", F.explode(F.coalesce(F.from_json("json", "array<struct<label:string,feature:string>>"), F.array())).alias("m")).select("judge", "batch", "m.label", "m.feature")
    known = marks.join(batches.select("batch", "label", "unit"), ["batch", "label"], "left")
    counts = known.groupBy("judge").agg(F.count("unit").alias("kept"), F.count_if(F.col("unit").isNull()).alias("dropped"))
    return known.filter("unit is not null").select("judge", "batch", "feature", "unit"), counts
