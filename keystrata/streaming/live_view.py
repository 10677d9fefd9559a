"""The live view over a stream of mutations, and a sink that flushes micro-batches to a keyspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import VALUE
from ..operators.store import Keyspace


def streaming_latest(log: DataFrame) -> DataFrame:
    """Newest record of each key; tombstones stay in the state, so a late older value cannot bring a key back."""
    return log.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("row")).select("key", "row.*")


def streaming_live(log: DataFrame) -> DataFrame:
    """For output mode ``complete``: exactly the batch answer after every micro-batch."""
    return streaming_latest(log).where(F.col("op") == VALUE).select("key", "value")


def flush_stream(log: DataFrame, keyspace: Keyspace, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Append and flush each micro-batch; what arrived is processed, then the query ends. A batch that is tried again is not appended twice."""

    def sink(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        keyspace.write(batch.withColumn("order", F.col(order)).select("order", "key", "op", "value"), (checkpoint, number))
        keyspace.flush()

    return log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
