"""Sharding by a permutation-filled lookup table (the published Maglev scheme).

Every shard has its own order of the slots of a prime-sized table, from two hashes of its name. Shards take turns claiming
the next free slot of their order until all are taken, so each has the same number within one. A key's shard is what the slot
of its hash holds: one lookup in a table of fixed size. Removing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4099
SHARDS = 32


def number(text: str) -> int:
    """The first 60 bits of the text's md5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot. slots must be prime and no smaller than the number of shards."""
    if not shards or slots < max(2, len(shards)) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots is needed, one for each shard at least")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    offset = [number(f"offset:{s}") % slots for s in shards]
    skip = [number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, step, free = [-1] * slots, [0] * len(shards), slots
    while free:
        for k in range(len(shards)):
            while table[slot := (offset[k] + step[k] * skip[k]) % slots] >= 0:
                step[k] += 1
            table[slot] = k
            step[k] += 1
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key_col: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """key, slot and shard of each row. Equal keys share a shard; null keys count as the empty text.

    The table of slots is a broadcast side of fixed size: slots rows of two numbers. No row is shuffled. Other columns don't matter.
    """
    shards = [f"shard-{k:03d}" for k in range(SHARDS)] if shards is None else shards
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, k, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot long, shard int, shard_name string")
    keyed = rows.select(F.col(key_col), slot_of(F.col(key_col), slots).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key_col, "slot", "shard", "shard_name")


def write_shards(rows: DataFrame, path: str, key_col: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS, files: int = 8, shard_col: str = "_shard") -> None:
    """Write rows, all columns as they are, partitioned by the number of their shard, each shard over `files` files at most, so that no task holds a whole one.

    Equal rows share a file. shard_col names the folders and must not be a column of rows; other names don't matter. No rows give an empty folder.
    """
    if shard_col in rows.columns:
        raise ValueError(f"rows have a column {shard_col}")
    shards = [f"shard-{k:03d}" for k in range(SHARDS)] if shards is None else shards
    table = rows.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard int")
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), slot_of(F.col(f"`{key_col}`"), slots).alias("slot"))
    dealt = packed.join(F.broadcast(table), "slot").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(files)))  # slots rows of two numbers
    dealt.repartition(len(shards) * files, "shard", "part").select("row.*", F.col("shard").alias(shard_col)).write.partitionBy(shard_col).parquet(path)
