"""Shards of even size that keep linked documents together: balanced label propagation by iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

#: Parts that a group's members are dealt over in joins, so that a group of a third of all rows has as many tasks.
SALTS = 32
#: Rows for each bin of a distributed ranking, and the most bins (their table stays small enough to broadcast).
BIN_ROWS, MOST_BINS = 20_000, 4096


def _bins(n: int) -> int:
    return max(16, min(MOST_BINS, n // BIN_ROWS))


def ranked(df: DataFrame, key: Column, n: int, order: list[Column], spread: Column, name: str) -> DataFrame:
    """``df`` with ``name``: places from 0 within ``key``, without gaps, ordered by bins of ``spread`` and ``order`` in them.

    ``key`` has few values (shards). Rows are ranked within a bin and the bins' counts are added up in a table of at
    most keys x ``MOST_BINS`` rows, so no task gets all rows of a key.
    """
    rows = df.withColumn("__key", key).withColumn("__bin", F.pmod(spread, F.lit(_bins(n))))
    counts = rows.groupBy("__key", "__bin").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("__key", "__bin", F.coalesce(before, F.lit(0)).alias("__before")))
    inner = F.row_number().over(Window.partitionBy("__key", "__bin").orderBy(*order))
    return rows.withColumn("__in", inner).join(offsets, ["__key", "__bin"]).withColumn(name, F.col("__before") + F.col("__in") - 1).drop("__key", "__bin", "__before", "__in")


def _lookup(values: list[int], index: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), index.cast("int"))


def propagate(members: DataFrame, capacity: list[int], store: Scratch, rounds: int = 8) -> DataFrame:
    """``row``, ``group``, ``shard`` for the rows of ``members`` (``row``, ``group``): linked rows drawn together.

    Each round counts every group's rows by shard (a partial aggregate). A group wishes for the shard that holds most of
    its rows among those with places free for the others, or for the emptiest shard if it fits there only; a group that fits
    nowhere wishes for the shard with any free place that holds most of it. Wishes are granted in a fixed order up to the shards' free
    places. Ends when nothing moves, so no group is cut that one round could have made whole.
    """
    n_shards = len(capacity)
    now = store.keep(members.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")), "labels0")
    total = now.count()
    for k in range(1, rounds + 1):
        held = {r.shard: r.n for r in now.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
        free = [max(0, c - held.get(s, 0)) for s, c in enumerate(capacity)]
        votes = now.groupBy("group", "shard").agg(F.count("*").alias("n"))
        emptiest = F.struct(F.lit(max(range(n_shards), key=free.__getitem__)).alias("shard"), F.lit(0).cast("long").alias("n"))
        sums = votes.groupBy("group").agg(F.sum("n").alias("rows"), F.collect_list(F.struct("shard", "n")).alias("at"))  # at most one entry a shard
        choice = sums.select("group", "rows", F.explode(F.concat("at", F.array(emptiest))).alias("c")).select("group", "rows", "c.shard", "c.n")
        room = _lookup(free, F.col("shard"))
        rank = F.struct((room >= F.col("rows") - F.col("n")).alias("whole"), (room > 0).alias("some"), "n", F.xxhash64("group", "shard").alias("tie"), "shard")
        best = choice.groupBy("group").agg(F.max(rank).alias("b")).select("group", F.col("b.shard").alias("wish"))
        best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wishes = now.withColumn("salt", F.pmod(F.xxhash64("row", "group"), F.lit(SALTS)).cast("int")).join(best, ["group", "salt"]).drop("salt")
        moving = ranked(wishes.where("wish <> shard"), F.col("wish"), total, [F.col("group"), F.col("row")], F.xxhash64("group", F.pmod(F.xxhash64("row"), F.lit(SALTS))), "place")
        granted = F.col("place") < _lookup(free, F.col("wish"))
        moved = moving.select("row", "group", F.when(granted, F.col("wish")).otherwise(F.col("shard")).alias("shard"), granted.alias("moves"))
        stay = wishes.where("wish = shard").select("row", "group", "shard", F.lit(False).alias("moves"))
        now = store.keep(moved.union(stay), f"labels{k}")
        store.drop(f"labels{k - 1}")
        if now.where("moves").isEmpty():
            break
    return now.select("row", "group", "shard")


def cut_edges(placed: DataFrame, group: str = "group", shard: str = "shard") -> DataFrame:
    """One row: ``edges``, the links of a path through each group, and ``cut``, the fewest of them that any path must cut."""
    each = placed.groupBy(group, shard).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("shards"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("edges"), F.coalesce(F.sum(F.col("shards") - 1), F.lit(0)).alias("cut"))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``size``, ``text_crc32``, ``group_rows``, ``shard``, ``slot``.

    Law ``rows``: shards differ by one row at most. Documents with equal texts (null as empty) are linked. Groups of
    several rows are placed by ``propagate``, what exceeds a shard's places and all single documents then fill the free places
    exactly. ``slot`` counts from 0 in each shard without gaps. ``size`` is the text's UTF-8 bytes plus 1, ``group_rows`` the
    number of rows with the text. Rows with equal or null ids are rows of their own. An empty table gives an empty result.
    """
    store = scratch or Scratch(docs.sparkSession, "shards")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("group"), F.monotonically_increasing_id().alias("row"))
    rows = store.keep(rows, "rows")
    n = rows.count()
    capacity = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    groups = rows.groupBy("group").agg(F.count("*").alias("group_rows")).where("group_rows > 1")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(spread, ["group", "salt"], "left").drop("salt")
    rows = store.keep(rows.withColumn("group_rows", F.coalesce("group_rows", F.lit(1))), "grouped")
    store.drop("rows")
    placed = propagate(rows.where("group_rows > 1").select("row", "group"), capacity, store, rounds)
    placing = F.xxhash64("group", F.pmod(F.xxhash64("row"), F.lit(SALTS)))  # a hot group has as many bins
    placed = ranked(placed, F.col("shard"), n, [F.col("group"), F.col("row")], placing, "place")
    placed = store.keep(placed.where(F.col("place") < _lookup(capacity, F.col("shard"))).select("row", "shard"), "placed")
    held = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = [c - held.get(s, 0) for s, c in enumerate(capacity)]
    all_rows = rows.join(placed, "row", "left")
    pool = ranked(all_rows.where("shard is null").drop("shard"), F.lit(0), n, [F.col("row")], F.xxhash64("row"), "place")
    shard, upto = F.lit(n_shards - 1), sum(free)
    for s in range(n_shards - 1, -1, -1):  # places from 0 fill the shards' free places in turn
        upto -= free[s]
        shard = F.when(F.col("place") < upto + free[s], F.lit(s)).otherwise(shard) if s < n_shards - 1 else shard
    pool = pool.withColumn("shard", shard.cast("int")).drop("place")
    done = store.keep(all_rows.where("shard is not null").unionByName(pool), "sharded")
    store.drop("grouped")
    # another hash than that of the pool: its bins became shards, so a shard's rows would share a few bins of it
    out = ranked(done, F.col("shard"), n, [F.col("id"), F.col("row")], F.xxhash64("row", F.lit("slot")), "slot")
    return out.select("id", "size", "text_crc32", "group_rows", "shard", F.col("slot").cast("long").alias("slot"))
