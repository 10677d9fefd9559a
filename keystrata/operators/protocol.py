"""The command layer in batches: validation, execution in request order, replies, and their delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..model import TOMBSTONE, VALUE
from ..plans.staging import ranged
from .visibility import live

#: Commands and the number of words each takes, its own name included.
ARITY = {"SET": 3, "GET": 2, "DEL": 2, "RSCAN": 2}


def upper_ascii(name: Column) -> Column:
    return F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def verdict(name: Column, argc: Column) -> Column:
    """``ok`` or the error message: unknown names are echoed as sent, wrong counts with the name in upper case."""
    want = F.lit(None).cast("int")
    for known, n in ARITY.items():
        want = F.when(upper_ascii(name) == known, n).otherwise(want)
    return F.when(argc == 0, "empty command").when(want.isNull(), F.concat(F.lit("unknown command '"), name, F.lit("'"))).when(argc != want, F.concat(F.lit("wrong number of arguments for '"), upper_ascii(name), F.lit("' command"))).otherwise("ok")


def execute(log: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new log, replies) of a batch of ``conn_id``, ``generation``, ``req_seq``, ``argv``, executed in ``req_seq`` order.

    A GET sees the log and the writes of smaller ``req_seq``. An RSCAN sees the log as it was before the batch together
    with the batch's earlier writes. DEL always succeeds. ``req_seq`` is global in the batch and orders it.
    """
    checked = commands.withColumn("argc", F.size("argv")).withColumn("said", verdict(F.get("argv", F.lit(0)), F.size("argv"))).withColumn("cmd", upper_ascii(F.get("argv", F.lit(0))))
    ok = checked.where("said = 'ok'").withColumn("key", F.get("argv", F.lit(1)))
    top = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
    writes = ok.where("cmd in ('SET', 'DEL')").select("req_seq", "key", F.when(F.col("cmd") == "SET", VALUE).otherwise(TOMBSTONE).cast("byte").alias("op"), F.when(F.col("cmd") == "SET", F.get("argv", F.lit(2))).otherwise("").alias("value"))
    added = writes.crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("req_seq")).alias("seq"), "key", "op", "value")
    # states and gets of a key in one order: the log lies before the batch
    states = log.select("key", F.lit(-1).cast("long").alias("at"), "seq", "op", "value").unionByName(writes.select("key", F.col("req_seq").alias("at"), F.col("req_seq").alias("seq"), "op", "value"))
    gets = ok.where("cmd = 'GET'").select("key", F.col("req_seq").alias("at"), "conn_id", "generation", "req_seq")
    before = Window.partitionBy("key").orderBy("at", F.col("seq").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lined = states.unionByName(gets, allowMissingColumns=True)
    seen = lined.withColumn("state", F.last(F.when(F.col("op").isNotNull(), F.struct("op", "value")), ignorenulls=True).over(before)).where("req_seq is not null")
    got = seen.select("conn_id", "generation", "req_seq", F.when(F.col("state.op") == VALUE, codec.bulk(F.col("state.value"))).otherwise(codec.null()).alias("reply"))
    wrote = ok.where("cmd in ('SET', 'DEL')").select("conn_id", "generation", "req_seq", codec.simple(F.lit("OK")).alias("reply"))
    wrong = checked.where("said <> 'ok'").select("conn_id", "generation", "req_seq", codec.error(F.col("said")).alias("reply"))
    scans = ok.where("cmd = 'RSCAN'").select("conn_id", "generation", "req_seq", F.col("key").alias("start"))
    newest = _scan_hits(states, scans)
    body = newest.groupBy("conn_id", "generation", "req_seq").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs"))
    scanned = scans.join(body, ["conn_id", "generation", "req_seq"], "left").select("conn_id", "generation", "req_seq", codec.array(F.flatten(F.transform(F.coalesce("pairs", F.expr("cast(array() as array<struct<key:string,value:string>>)")), lambda p: F.array(p["key"], p["value"])))).alias("reply"))
    replies = got.unionByName(wrote).unionByName(wrong).unionByName(scanned)
    return log.unionByName(added), replies


def _scan_hits(states: DataFrame, scans: DataFrame) -> DataFrame:
    """The visible pairs of every scan: ``conn_id``, ``generation``, ``req_seq``, ``key``, ``value``; as many rows as the replies list.

    A state holds from its place in the batch to the key's next one, so no state is met twice. Keys lie in range partitions,
    and a scan meets only those whose greatest key it reaches: an equality join on the partition.
    """
    line = Window.partitionBy("key").orderBy("at", "seq")
    held = states.withColumn("until", F.lead("at").over(line)).where(f"op = {VALUE} and (until is null or until > at)")
    rows = ranged(held.select("key", "value", "at", "until"), ["key", "at"], "scans").drop("_nth")
    tops = rows.groupBy("_part").agg(F.max("key").alias("top"))  # one row for each range partition
    dealt = scans.crossJoin(F.broadcast(tops)).where("top >= start").select("conn_id", "generation", "req_seq", "start", "_part")
    met = rows.join(dealt, "_part").where("key >= start and at < req_seq and (until is null or until >= req_seq)")
    return met.select("conn_id", "generation", "req_seq", "key", "value")


def parse_requests(pieces: DataFrame) -> DataFrame:
    """Commands from pieces of connections' bytes (``conn_id``, ``piece``, ``data`` binary): ``conn_id``, ``req_seq``, ``argv``, ``error``.

    A table function streams each connection's pieces in order and keeps only what is left over, so no connection is
    gathered. A damaged request gives one last row with its error; the connection is closed and the rest of it ignored.
    """
    rows = pieces.select("conn_id", "piece", F.col("data").cast("binary").alias("data"))
    return codec.ParseRequests(rows.asTable().partitionBy("conn_id").orderBy("piece"))


def emittable(replies: DataFrame, done: str = "done", next_seq: int = 0) -> DataFrame:
    """Replies that may go out: the gapless finished prefix of each connection from ``next_seq`` on."""
    gaps = replies.groupBy("conn_id").agg(F.min(F.when(~F.col(done), F.col("req_seq"))).alias("gap"))
    return replies.where(F.col("req_seq") >= next_seq).join(gaps, "conn_id").where("gap is null or req_seq < gap").drop("gap")


def fence(completions: DataFrame, current: DataFrame) -> DataFrame:
    """Completions of the connections that are still open: a reused descriptor has another generation."""
    return completions.join(current, ["fd", "generation"], "left_semi")


def get_replies(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.when(F.col("op") == VALUE, codec.bulk(F.col("value"))).otherwise(codec.null()).alias("reply"))


def scan_reply(log: DataFrame, start) -> DataFrame:
    """One flat array reply of a whole scan; by nature one row that holds the result."""
    pairs = live(log.where(F.col("key") >= start)).select("key", "value")
    listed = pairs.agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("p"))
    return listed.select(codec.array(F.flatten(F.transform("p", lambda x: F.array(x["key"], x["value"])))).alias("reply"))
