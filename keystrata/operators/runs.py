"""Sorted immutable runs: flush, block layout, compaction between levels, and the rotation of memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES, ROTATION_KEYS, TOMBSTONE, VALUE
from ..plans.latest import by_window


def flush(log: DataFrame) -> DataFrame:
    """One record for each (run, key), the newest; tombstones stay, as older runs may hold the key."""
    return by_window(log, keys=("run", "key"))


def flush_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("op") == TOMBSTONE).alias("tombs"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def newest_of(runs: DataFrame, order: str = "run") -> DataFrame:
    """Latest-wins over several runs; a run holds a key once."""
    return by_window(runs, order=order)


def compact(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Merge level-0 runs above level 1: ``key``, ``op``, ``value`` of the run that is added to level 1.

    Values go on. A tombstone goes on only where level 1's newest record of the key is a value; with nothing
    visible below, it has done its work.
    """
    top = newest_of(upper).select("key", "op", "value")
    visible = newest_of(lower).where(F.col("op") == VALUE).select("key")
    buried = top.where(F.col("op") == TOMBSTONE).join(visible, "key", "left_semi").withColumn("value", F.lit("").cast(top.schema["value"].dataType))
    return top.where(F.col("op") == VALUE).unionByName(buried)


def dropped_tombstones(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Keys whose tombstone a compaction discards."""
    visible = newest_of(lower).where(F.col("op") == VALUE).select("key")
    return newest_of(upper).where(F.col("op") == TOMBSTONE).select("key").join(visible, "key", "left_anti")


def full_compaction(runs: DataFrame) -> DataFrame:
    """Rewrite of all levels: the visible state alone."""
    return newest_of(runs).where(F.col("op") == VALUE)


def write_run(rows: DataFrame, path: str) -> None:
    """A run as Parquet: disjoint key ranges, sorted, with a Bloom filter on the key."""
    sorted_rows = rows.repartitionByRange("key").sortWithinPartitions("key")
    sorted_rows.write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def entry_bytes(key: Column, value: Column) -> Column:
    """Encoded size: two four-byte lengths, the type byte, key and value."""
    return F.octet_length(key) + F.octet_length(value) + 9


def run_bytes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run").agg(F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("data_bytes"))


def assign_blocks(runs: DataFrame, target: int = BLOCK_BYTES) -> DataFrame:
    """``run``, ``key``, ``size``, ``block``, ``at``: greedy cut, a block closes once it has reached ``target``.

    The cut restarts from each block's end, so prefix sums cannot give it; a run's sizes stream through one fold. Runs are
    bounded by the memory table that they were flushed from, so a run is one small group.
    """

    def fold(pdf):
        pdf = pdf.sort_values("key", key=lambda s: s.map(lambda k: k.encode() if isinstance(k, str) else bytes(k)))
        blocks, block, used = [], 0, 0
        for size in pdf["size"].tolist():
            if used >= target:
                block, used = block + 1, 0
            blocks.append(block)
            used += size
        pdf["block"] = blocks
        pdf["at"] = pdf["size"].cumsum() - pdf["size"]
        return pdf

    kind = runs.schema["key"].dataType.simpleString()
    sized = runs.select("run", "key", entry_bytes(F.col("key"), F.col("value")).cast("long").alias("size"))
    return sized.groupBy("run").applyInPandas(fold, f"run int, key {kind}, size long, block long, at long")


def block_index(blocks: DataFrame) -> DataFrame:
    """Sparse index: last key, offset and size of each block."""
    return blocks.groupBy("run", "block").agg(F.max("key").alias("last_key"), F.min("at").alias("offset"), F.sum("size").alias("bytes"))


def find_block(index: DataFrame, key) -> DataFrame:
    """First block of each run whose last key is not below ``key``."""
    return index.where(F.col("last_key") >= key).groupBy("run").agg(F.min_by("block", "last_key").alias("block"))


def rotation_epochs(log: DataFrame, most_keys: int = ROTATION_KEYS) -> DataFrame:
    """``seq``, ``epoch``: a new epoch begins with the write that finds ``most_keys`` distinct keys in the table.

    The count restarts with every epoch. One writer's log is one sequence, so it streams through a single ordered fold whose
    state is the keys of the open epoch; columns other than ``seq`` and ``key`` stay behind.
    """

    def fold(batches):
        keys, epoch = set(), 0
        for pdf in batches:
            out = []
            for k in pdf["key"].tolist():
                if len(keys) >= most_keys:
                    keys, epoch = set(), epoch + 1
                keys.add(k)
                out.append(epoch)
            yield pdf[["seq"]].assign(epoch=out)

    ordered = log.select("seq", "key").repartition(1).sortWithinPartitions("seq")
    return ordered.mapInPandas(fold, "seq long, epoch long")


def status(runs: DataFrame, memory_run: int, level0: list[int]) -> DataFrame:
    """One row of metrics: entries in memory, runs by level, estimated memory."""
    in_memory = F.count_if(F.col("run") == memory_run)
    return runs.agg(
        in_memory.alias("mem_count"), F.count_distinct(F.when(F.col("run").isin(level0), F.col("run"))).alias("l0_count"),
        F.count_distinct(F.when(F.col("run") < min(level0), F.col("run"))).alias("l1_count"), (in_memory * 128).alias("approx_mem_bytes"),
    )


def checkpoints(edits: DataFrame, group: str, every: int) -> DataFrame:
    """Edits by group, full checkpoints and edits since the last one."""
    n = F.count("*")
    return edits.groupBy(F.col(group).alias("grp")).agg(n.alias("edits"), F.floor(n / every).alias("checkpoints"), (n % every).alias("edits_since"))
