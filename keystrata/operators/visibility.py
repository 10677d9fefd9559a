"""The visible state of a mutation log: latest record for each key first, tombstones out after that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TOMBSTONE, VALUE
from ..plans.latest import STRATEGIES
from ..plans.staging import ranged


def latest(log: DataFrame, strategy: str = "window") -> DataFrame:
    """Newest record of each key, tombstones included."""
    return STRATEGIES[strategy](log)


def live(log: DataFrame, strategy: str = "window") -> DataFrame:
    """Visible pairs. The tombstone filter stands above the dedupe: below it, deleted keys would come back."""
    return latest(log, strategy).where(F.col("op") == VALUE)


def put(log: DataFrame, records: DataFrame) -> DataFrame:
    """Append mutations (``key``, ``op``, ``value``, ``order``): they get the next sequence numbers in their order.

    The numbering ranks the new batch only; the old log is touched for its greatest number.
    """
    top = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
    numbered = global_positions(records, ["order"])
    return log.unionByName(numbered.crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("pos")).alias("seq"), "key", "op", "value"))


def erase(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The log without any record of ``keys``: a physical delete, unlike a tombstone. Null keys erase nothing."""
    return log.join(keys.select("key"), "key", "left_anti").select(log.columns)


def point_get(log: DataFrame, key) -> DataFrame:
    """Value of one key, or no row. The predicate is on the dedupe's key, so Catalyst moves it into the scan."""
    return live(log.where(F.col("key") == key)).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Every probe key with its value; null where it has none."""
    return keys.join(live(log).select("key", "value"), "key", "left")


def get_status(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Tri-state lookup: hit, tombstone or absent."""
    found = keys.join(latest(log).select("key", "op"), "key", "left")
    return found.select("key", F.when(F.col("op").isNull(), "absent").when(F.col("op") == TOMBSTONE, "tombstone").otherwise("hit").alias("status"))


def tier_get(latest_rows: DataFrame, tier: Column) -> DataFrame:
    """Which tier answers for each key, and with what."""
    return latest_rows.select("key", tier.alias("tier"), "op")


def scan_from(log: DataFrame, start=None, end=None, prefix=None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Visible pairs from a lower bound on, in key order; bounds and prefix reach the scan below the dedupe.

    ``reverse`` goes down from the greatest key; ``limit`` takes the first pairs of that order, by partial top lists.
    """
    rows = log
    if start is not None:
        rows = rows.where(F.col("key") >= start)
    if end is not None:
        rows = rows.where(F.col("key") < end)
    if prefix is not None:
        rows = rows.where(F.startswith("key", F.lit(prefix)))
    out = live(rows).select("key", "value").orderBy(F.col("key").desc() if reverse else F.col("key"))
    return out.limit(limit) if limit is not None else out


def scan_flat(log: DataFrame, start) -> DataFrame:
    """The scan as one flat list k1, v1, k2, v2, ...: ``pos`` and ``element``.

    Places come from ranks within range partitions and the partitions' counts, not from one global window.
    """
    pairs = live(log.where(F.col("key") >= start)).select("key", "value")
    placed = global_positions(pairs, ["key"])
    return placed.select(F.explode(F.array(F.struct((2 * F.col("pos")).alias("pos"), F.col("key").alias("element")), F.struct((2 * F.col("pos") + 1).alias("pos"), F.col("value").alias("element")))).alias("e")).select("e.*")


def global_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``pos`` from 0 in a total order: the place in a range partition and the counts of the partitions before it."""
    placed = ranged(df, order, "positions")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each range partition: bounded by the partition count whatever the data
    offsets = F.broadcast(counts.select(F.col("_part").alias("_of"), before.alias("_before")))
    return placed.join(offsets, F.col("_part") == F.col("_of"), "left").withColumn("pos", F.col("_before") + F.col("_nth")).drop("_part", "_of", "_nth", "_before")


def seek(log: DataFrame, probes: DataFrame, probe: str = "probe") -> DataFrame:
    """Least visible key at or above each probe; null past the end.

    Probes and keys are sorted together and each probe takes the next key after it: a merge, not a product. From a range
    partition's end a running minimum takes each row once; what lies beyond comes from the partitions' first keys.
    """
    keys = live(log).select(F.col("key").alias("k"), F.lit(1).alias("is_key"))
    both = ranged(keys.unionByName(probes.select(F.col(probe).alias("k"), F.lit(0).alias("is_key"))), ["k", "is_key"], "seek")
    from_end = Window.partitionBy("_part").orderBy(F.col("_nth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("found", F.min(F.when(F.col("is_key") == 1, F.col("k"))).over(from_end)).where("is_key = 0")
    return near.join(_later(both.withColumn("first", F.when(F.col("is_key") == 1, F.col("k")))), "_part").select(F.col("k").alias(probe), F.coalesce("found", "later").alias("found"))


def _later(rows: DataFrame) -> DataFrame:
    """The least ``first`` of all partitions after each ``_part``: one row for each range partition."""
    firsts = rows.groupBy("_part").agg(F.min("first").alias("first"))
    return F.broadcast(firsts.select("_part", F.min("first").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)).alias("later")))


def next_keys(log: DataFrame) -> DataFrame:
    """Each visible key with its successor, null for the last: an iterator's step, without a global window."""
    rows = ranged(live(log).select("key"), ["key"], "next")
    inner = F.lead("key").over(Window.partitionBy("_part").orderBy("_nth"))
    return rows.withColumn("near", inner).join(_later(rows.withColumn("first", F.col("key"))), "_part").select("key", F.coalesce("near", "later").alias("next_key"))


def point_in_time(log: DataFrame) -> DataFrame:
    """What a GET placed at each row's ``seq`` would see: the key's state after all smaller ``seq``."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = log.select("seq", "key", F.last("op").over(before).alias("op"), F.last("value").over(before).alias("value"))
    return seen.select("seq", "key", F.when(F.col("op") == VALUE, F.col("value")).alias("got"))
