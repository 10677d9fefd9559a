"""Tables written to the shared folder: later steps neither recompute them nor depend on executors' disks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only where all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or f"{tempfile.gettempdir()}/keystrata-shared").rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back. Readers of a lazy result need the table, so it stays until the folder is cleared."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` in range partitions of ``order``, with ``_part`` (the partition's number) and ``_nth`` (place in it, from 0).

    Both are facts of one execution: were the plan run twice, its sampled bounds and merged partitions could differ between the
    two. So the rows are numbered as they are written, and every later step reads that one table.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    return staged(rows, label).withColumn("_part", F.shiftright("_row", 33)).withColumn("_nth", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row")
