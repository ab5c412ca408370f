"""A corpus pipeline of four stages: quality selection, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, minhash_dedup, mixing, quality
from tidemark.llm.queries import SELECT_GRADE, grade
from tidemark.session import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose probability of the highest grade is a half or more."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), grade())
    return quality.select(docs, model, SELECT_GRADE).select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that with the least id, of each group of near duplicates.

    Rows with one id are one document: the first by text stays. A null id is settled by text: for grouping it is a number
    above 2**62 from the text's hash, so equal texts are one document and a row with an id stays rather than one without.
    """
    by_text = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    named = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), by_text))
    found = minhash_dedup.near_duplicates(named.select("key", "text"), id_col="key")
    kept = found.filter("kept").select("key").distinct()
    first = named.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("text", "lang", "source", "n_chars"))).filter("place = 1")
    return first.join(kept, "key", "left_semi").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mix takes it; those not taken go."""
    return mixing.repeat(docs).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifier, the mix's hash keys and the encoding have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
