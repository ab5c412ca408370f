"""Canonical logs: scan, validation, normal form, index and work stores, windows and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import QueryError

#: Fixed values of the log format.
EVENT_KINDS = ["message", "action", "result", "reasoning", "read", "call", "return", "self_report"]
ACTOR_KINDS = ["agent", "human", "system"]

EVENTS = "id string, ts string, actor string, kind string, text string, channel string, reply_to string, url string, to array<string>, meta string, _bad string"
ACTORS = "id string, label string, kind string, role string, model string, parent string, lineage string, aliases array<string>, _bad string"
WORK = {
    "tags": "event_id string, tags array<string>, other string, summary string, confidence string",
    "concerns": "event_id string, kind string, quote string, confidence string, basis string, unconfirmed string",
    "hypotheses": "id long, text string, metric string, op string, target double, status string, value double, verdict string",
}


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; empty lines are skipped, a malformed one is kept in _bad for the validator. A scalar `to` becomes a list of one."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    fixed = F.regexp_replace("value", r'("to"\s*:\s*)("(?:[^"\\]|\\.)*")(\s*[,}])', "$1[$2]$3")
    parsed = F.from_json(fixed, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("r"), F.input_file_name().alias("_file")).select("r.*", "_file")


def timestamp_of(text: Column) -> Column:
    """UTC: an explicit offset is applied, a Z is dropped, no zone means UTC."""
    bare = F.regexp_replace(F.replace(text, F.lit("T"), F.lit(" ")), r"Z$", "")
    return F.try_to_timestamp(bare)


def problems(events: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """what, id of everything that breaks the format; empty if the log is sound."""
    needed = F.col("id").isNull() | F.col("ts").isNull() | F.col("actor").isNull()
    found = [
        events.filter(F.col("_bad").isNotNull()).select(F.lit("malformed line").alias("what"), F.substring("_bad", 1, 80).alias("id")),
        events.filter(F.col("_bad").isNull() & needed).select(F.lit("id, ts or actor is missing"), "id"),
        events.filter(F.col("ts").isNotNull() & timestamp_of(F.col("ts")).isNull()).select(F.lit("bad time"), "id"),
        events.filter(F.col("kind").isNotNull() & ~F.col("kind").isin(EVENT_KINDS)).select(F.lit("unknown kind"), "id"),
        events.filter("id is not null").groupBy("id").count().filter("count > 1").select(F.lit("id repeats"), "id"),
    ]
    if actors is not None:
        found.append(actors.filter(F.col("id").isNull() | (F.col("kind").isNotNull() & ~F.col("kind").isin(ACTOR_KINDS))).select(F.lit("bad actor"), "id"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def normalise(events: DataFrame) -> DataFrame:
    """The canonical columns with defaults; t in whole epoch seconds."""
    ts = timestamp_of(F.col("ts"))
    return events.select(
        "id", ts.alias("ts"), F.unix_timestamp(ts).alias("t"), "actor", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
        "channel", "reply_to", "url", F.coalesce("to", F.array().cast("array<string>")).alias("to"), "meta",
    )


def with_actors(events: DataFrame, actors: DataFrame) -> DataFrame:
    """actors and those that only events name."""
    named = events.select(F.col("actor").alias("id")).union(events.select(F.explode("to"))).distinct().join(actors, "id", "left_anti")
    return actors.unionByName(named.select("id", F.col("id").alias("label"), F.lit("agent").alias("kind")), allowMissingColumns=True)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Validated events and actors of a dataset folder with events.jsonl and actors.jsonl."""
    events, actors = scan_jsonl(spark, f"{folder}/events.jsonl", EVENTS), scan_jsonl(spark, f"{folder}/actors.jsonl", ACTORS)
    wrong = problems(events, actors).limit(5).collect()
    if wrong:
        raise QueryError("; ".join(f"{r['what']}: {r['id']}" for r in wrong))
    sound = normalise(events)
    return sound, with_actors(sound, actors.drop("_bad", "_file"))


def write_index(folder: str, **tables: DataFrame) -> None:
    """Each table as parquet; events by day, so that time windows prune partitions. Ranges of time deal the rows out, so a busy day has several files."""
    for name, df in tables.items():
        if name == "events":
            df = df.withColumn("day", F.to_date(F.timestamp_seconds("t")))
            df.repartitionByRange("day", "t", "id").sortWithinPartitions("day", "t", "id").write.mode("overwrite").partitionBy("day").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_text_index(folder: str, index: DataFrame, buckets: int = 64) -> None:
    """The words of texts (operators.reuse.text_index) in folders by hash of the word, sorted, so that a request reads a few row groups."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    index.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")


def open_text_index(spark: SparkSession, folder: str, words: list[str], buckets: int = 64) -> DataFrame:
    """The index rows of some words: only their folders are read."""
    wanted = [w.lower() for w in words]
    places = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets)).alias(str(k)) for k, w in enumerate(wanted)]).first()
    return spark.read.parquet(f"{folder}/terms").filter(F.col("bucket").isin(sorted({int(p) for p in places})) & F.col("term").isin(wanted))


def open_index(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    out = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def open_work(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A work table; empty with its schema if it hasn't been written, with nulls for columns that older files lack."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], WORK[name])
    return spark.read.schema(WORK[name]).option("mergeSchema", "true").parquet(f"{folder}/{name}")


def put(spark: SparkSession, folder: str, key: str, value: str) -> None:
    """Store a JSON text under a key, replacing what was there."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/kv/key={key}")


def get(spark: SparkSession, folder: str, key: str) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/kv/key={key}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("wholetext", True).text(f"{folder}/kv/key={key}").first()[0].rstrip("\n")


def split(events: DataFrame, work: dict[str, DataFrame], cut: int) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Events before cut, from cut on, and the work rows of the former."""
    train, test = events.filter(F.col("t") < cut), events.filter(F.col("t") >= cut)
    ids = train.select(F.col("id").alias("event_id"))
    return train, test, {n: w.join(ids, "event_id", "left_semi") for n, w in work.items()}


def export_bundle(events: DataFrame, folder: str, files: int = 32) -> None:
    """JSON over a fixed number of files by hash of the id."""
    events.repartition(files, F.pmod(F.hash("id"), F.lit(files))).write.mode("overwrite").json(folder)
