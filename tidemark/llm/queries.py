"""Queries over the whole document, embedding, page and conversation tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe_codec, embedding_dedup, html_main, merkle, minhash_dedup, mixing, quality, sharding, token_count, tool_calls

SELECT_GRADE = 2


def grade() -> Column:
    """0 if rated low, 1 if rated high but toxic, 2 if rated high and clean; null, and so left out, without both ratings. Selection asks for grade 2."""
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return F.when(known & (F.col("quality") == 0), 0).when(known & (F.col("toxic") == 1), 1).when(known, 2)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), grade())
    return quality.classify(documents, model, SELECT_GRADE)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(table(spark, sf_dir, "conversations"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_embedding_near_dedup, op2_quality_classifier, op3_sharding, op4_minhash_near_dedup, op5_tool_call_linking, op6_merkle_fingerprints, op7_html_extraction, op8_token_counts, op9_source_mixing, op10_bpe_codec)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Sharding only: its table is filled by a recursive query that claims one slot a step."""
    return {"op3_sharding": SHARDING_SQL}


SHARDING_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 3, '0') AS name FROM range({sharding.SHARDS}) t(k)
), numbered AS (
  SELECT k, name,
         ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {sharding.SLOTS} AS off,
         ('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {sharding.SLOTS - 1} + 1 AS skip
  FROM shards
), orders AS (
  SELECT list(off ORDER BY k) AS offs, list(skip ORDER BY k) AS skips FROM numbered
), claims AS (
  SELECT 0::BIGINT AS turn, list_transform(range({sharding.SLOTS}), lambda i: true) AS free, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, list_transform(free, lambda f, i: f AND i <> claimed + 1), claimed
  FROM (
    SELECT turn, free, (off + list_extract(list_filter(range({sharding.SLOTS}), lambda j: free[(off + j * skip) % {sharding.SLOTS} + 1]), 1) * skip) % {sharding.SLOTS} AS claimed
    FROM (
      SELECT c.turn, c.free, o.offs[c.turn % {sharding.SHARDS} + 1] AS off, o.skips[c.turn % {sharding.SHARDS} + 1] AS skip
      FROM claims c, orders o WHERE c.turn < {sharding.SLOTS}
    )
  )
), lookup AS (
  SELECT slot, (turn - 1) % {sharding.SHARDS} AS shard FROM claims WHERE turn > 0
), keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents
)
SELECT doc_id, k.slot, l.shard::INTEGER AS shard, s.name AS shard_name
FROM keyed k JOIN lookup l ON k.slot = l.slot JOIN shards s ON s.k = l.shard
"""
