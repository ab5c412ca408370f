"""Session helpers: the shared folder for cut lineage, and scans with UTC timestamps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEST_CHECKPOINT_DIR = "/tmp/checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; where none is set, a local one on a local master (tests), else none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(folder or TEST_CHECKPOINT_DIR)


def cut(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared checkpoint folder and read it: the plan restarts there and survives lost executors.

    A checkpoint would keep the sizes that the optimiser has estimated; those of joins are products, and in loops grow without end.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan a parquet table; NTZ timestamps become instants (the session is in UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(ntz) if ntz else df
