"""Registered queries of the key-value engine over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bloom, codec
from .model import ADD_RUN, CHECKPOINT_EDITS, DROP_RUN, SET_NEXT, TOMBSTONE, VALUE
from .operators import protocol, recovery, runs, visibility
from .oracles import LATEST, LOG, ORACLES, RUNS

#: The log is cut into this many runs: 0 to 4 play level 1, 5 and 6 level 0, the last one memory.
EPOCHS, LEVEL1, LEVEL0, MEMORY = 8, 5, [5, 6], 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mutations of their user's key: errors delete, everything else writes its properties."""
    events = table(spark, sf_dir, "events")
    deletes = F.col("event_type") == "error"
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), F.when(deletes, TOMBSTONE).otherwise(VALUE).alias("op"), F.when(deletes, "").otherwise(F.col("props")).alias("value"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its epoch; the row count comes from the files' metadata."""
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    return mutation_log(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("run", F.floor(F.col("seq") * F.lit(float(EPOCHS)) / F.col("n")).cast("int")).drop("n")


def _probes(spark, sf_dir, name="key"):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias(name)).distinct()


def _levels(spark, sf_dir):
    flushed = runs.flush(run_log(spark, sf_dir))
    return flushed, flushed.where(F.col("run").isin(LEVEL0)), flushed.where(F.col("run") < LEVEL1)


def live(spark, sf_dir):
    return visibility.live(mutation_log(spark, sf_dir)).select("key", "value")


def live_semi(spark, sf_dir):
    return visibility.live(mutation_log(spark, sf_dir), "semi").select("key", "value")


def live_struct(spark, sf_dir):
    return visibility.live(mutation_log(spark, sf_dir), "struct").select("key", "value")


def get_tristate(spark, sf_dir):
    return visibility.get_status(mutation_log(spark, sf_dir), _probes(spark, sf_dir))


def point_get(spark, sf_dir):
    return visibility.point_get(mutation_log(spark, sf_dir), "7")


def multi_get(spark, sf_dir):
    return visibility.multi_get(mutation_log(spark, sf_dir), _probes(spark, sf_dir))


def level_get(spark, sf_dir):
    tier = F.when(F.col("run") == MEMORY, "mem").when(F.col("run").isin(LEVEL0), "l0").otherwise("l1")
    return visibility.tier_get(visibility.latest(run_log(spark, sf_dir)), tier)


def rscan_from(spark, sf_dir):
    return visibility.scan_from(mutation_log(spark, sf_dir), "3")


def bounded_scan(spark, sf_dir):
    return visibility.scan_from(mutation_log(spark, sf_dir), "2", "7")


def prefix_scan(spark, sf_dir):
    return visibility.scan_from(mutation_log(spark, sf_dir), prefix="1")


def rscan_flat(spark, sf_dir):
    return visibility.scan_flat(mutation_log(spark, sf_dir), "3")


def seek_lower_bound(spark, sf_dir):
    return visibility.seek(mutation_log(spark, sf_dir), _probes(spark, sf_dir, "probe"))


def iterator_next(spark, sf_dir):
    return visibility.next_keys(mutation_log(spark, sf_dir))


def run_foreach(spark, sf_dir):
    return _levels(spark, sf_dir)[0].select("run", "key", "op", "value")


def memory_snapshot(spark, sf_dir):
    return visibility.latest(run_log(spark, sf_dir).where(F.col("run") == MEMORY)).select("key", "op", "value")


def minor_flush_stats(spark, sf_dir):
    return runs.flush_stats(_levels(spark, sf_dir)[0])


def l0_to_l1_compact(spark, sf_dir):
    _, upper, lower = _levels(spark, sf_dir)
    return runs.compact(upper, lower)


def dropped_tombstones(spark, sf_dir):
    _, upper, lower = _levels(spark, sf_dir)
    return runs.dropped_tombstones(upper, lower)


def full_compaction(spark, sf_dir):
    return runs.full_compaction(_levels(spark, sf_dir)[0]).select("key", "value")


def compaction_invariant(spark, sf_dir):
    """Visible rows before and after a compaction of level 0, and rows in which they differ."""
    flushed, upper, lower = _levels(spark, sf_dir)
    tiers = flushed.where(F.col("run") == MEMORY).select("key", "op", "value", F.lit(3).alias("run"))
    tiers = tiers.unionByName(runs.compact(upper, lower).withColumn("run", F.lit(2))).unionByName(runs.newest_of(lower).select("key", "op", "value", F.lit(1).alias("run")))
    after = runs.full_compaction(tiers).select("key", "value", F.lit(1).alias("side"))
    both = live(spark, sf_dir).withColumn("side", F.lit(0)).unionByName(after)
    met = both.groupBy("key", "value").agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("a"))
    return met.agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.sum(F.abs(F.col("b") - F.col("a"))).alias("differences"))


def run_data_bytes(spark, sf_dir):
    return runs.run_bytes(_levels(spark, sf_dir)[0])


def block_cut(spark, sf_dir):
    return runs.assign_blocks(_levels(spark, sf_dir)[0]).select("run", "key", "block")


def block_index(spark, sf_dir):
    return runs.block_index(runs.assign_blocks(_levels(spark, sf_dir)[0]))


def index_lookup(spark, sf_dir):
    return runs.find_block(runs.block_index(runs.assign_blocks(_levels(spark, sf_dir)[0])), "5")


def memtable_rotation(spark, sf_dir):
    """Epochs of the log in memory tables of a hundred distinct keys."""
    return runs.rotation_epochs(mutation_log(spark, sf_dir), 100)


def bloom_filter_bytes(spark, sf_dir):
    return bloom.filter_bytes(_levels(spark, sf_dir)[0])


def bloom_hash(spark, sf_dir):
    return mutation_log(spark, sf_dir).select("key").distinct().select("key", bloom.bloom_hash(F.col("key")).alias("h"))


def bloom_may_match(spark, sf_dir):
    flushed = _levels(spark, sf_dir)[0]
    numbers = flushed.select("run").distinct()
    probes = _probes(spark, sf_dir).join(F.broadcast(numbers))  # eight runs
    return bloom.may_match(bloom.create_filters(flushed), probes)


def wal_corrupt_prefix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return recovery.good_prefix(lines, F.col("l_orderkey") % 16, F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_discount") > 0.09)


def wal_replay_order(spark, sf_dir):
    return recovery.replay_order(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("wal")).distinct())


def wal_replay(spark, sf_dir):
    """Sixteen logs replayed in numeric order; the visible state follows the replay's sequence."""
    records = mutation_log(spark, sf_dir).select((F.col("seq") % 16).alias("wal_id"), F.col("seq").alias("ordinal"), "key", "op", "value")
    return visibility.live(recovery.replay(records)).select("key", "value")


def _edits(spark, sf_dir):
    state = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit_seq"), F.when(state == "F", DROP_RUN).otherwise(ADD_RUN).alias("op"), F.col("o_custkey").alias("id"), F.when(state == "O", 0).otherwise(1).alias("level"))


def manifest_fold(spark, sf_dir):
    return recovery.valid_levels(recovery.fold_edits(_edits(spark, sf_dir))).select("id", "level")


def next_file_number(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return recovery.next_file_number(orders.select(F.col("o_orderkey").alias("edit_seq"), F.lit(SET_NEXT).alias("op"), F.col("o_custkey").alias("id")))


def manifest_checkpoint(spark, sf_dir):
    return runs.checkpoints(table(spark, sf_dir, "orders"), "o_orderpriority", CHECKPOINT_EDITS)


def status_metrics(spark, sf_dir):
    return runs.status(_levels(spark, sf_dir)[0], MEMORY, LEVEL0)


def resp_get_reply(spark, sf_dir):
    return protocol.get_replies(visibility.latest(mutation_log(spark, sf_dir)))


def resp_array_reply(spark, sf_dir):
    return protocol.scan_reply(mutation_log(spark, sf_dir), "3")


def resp_encoders(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    name = F.col("n_name")
    return rows.select("n_nationkey", codec.simple(name).alias("simple"), codec.error(name).alias("error"), codec.integer(F.col("n_nationkey")).alias("integer"), codec.bulk(name).alias("bulk"), codec.null().alias("null_bulk"), codec.array(F.array(name, F.col("n_regionkey").cast("string"))).alias("array"))


def reply_order_prefix(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    replies = table(spark, sf_dir, "events").select(F.col("user_id").alias("conn_id"), place.alias("req_seq"), (F.col("event_id") % 7 != 0).alias("done"))
    return protocol.emittable(replies).groupBy("conn_id").agg(F.count("*").alias("emittable"))


def generation_fence(spark, sf_dir):
    done = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 16).alias("fd"), F.col("user_id").alias("generation"))
    current = done.groupBy("fd").agg(F.max("generation").alias("generation"))
    return protocol.fence(done, current).select("event_id", "fd")


def dispatch_validate(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    name = F.when(kind == "view", "get").when(kind == "click", "SET").when(kind == "error", "del").when(kind == "purchase", "RScan").otherwise("ping")
    return events.select("event_id", protocol.verdict(name, (1 + F.col("event_id") % 3).cast("int")).alias("verdict"))


def batch_point_in_time_get(spark, sf_dir):
    return visibility.point_in_time(mutation_log(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        live, live_semi, live_struct, get_tristate, point_get, multi_get, level_get, rscan_from, bounded_scan, prefix_scan, rscan_flat, seek_lower_bound, iterator_next, run_foreach, memory_snapshot,
        minor_flush_stats, l0_to_l1_compact, dropped_tombstones, full_compaction, compaction_invariant, run_data_bytes, block_cut, block_index, index_lookup, memtable_rotation, bloom_filter_bytes, bloom_hash,
        bloom_may_match, wal_corrupt_prefix, wal_replay_order, wal_replay, manifest_fold, next_file_number, manifest_checkpoint, status_metrics, resp_get_reply, resp_array_reply, resp_encoders,
        reply_order_prefix, generation_fence, dispatch_validate, batch_point_in_time_get,
    )
}

_SIZE = "(9 + octet_length(encode(key)) + octet_length(encode(value)))"
_CUT = f"""s AS (SELECT run, key, {_SIZE} AS size, ROW_NUMBER() OVER (PARTITION BY run ORDER BY key) AS i FROM runs),
c(run, i, key, size, block, used, pos) AS (SELECT run, i, key, size, 0, size, 0 FROM s WHERE i = 1
UNION ALL SELECT s.run, s.i, s.key, s.size, CASE WHEN c.used >= 4096 THEN c.block + 1 ELSE c.block END, CASE WHEN c.used >= 4096 THEN s.size ELSE c.used + s.size END, c.pos + c.size FROM s JOIN c ON s.run = c.run AND s.i = c.i + 1)"""
_HASH = """list_reduce(list_concat([xor(3164544308, octet_length(encode(key))::BIGINT)], [CAST(ascii(c) AS BIGINT) FOR c IN string_split(key, '')]), lambda h, b: xor((xor(h, b) * 1540483477) & 4294967295, ((xor(h, b) * 1540483477) & 4294967295) >> 15))"""
_BITS = "[CAST((h + j * (((h >> 17) | (h << 15)) & 4294967295)) & 4294967295 AS BIGINT) % bits FOR j IN range(6)]"
_CUSTOMERS = "(SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer)"
_BULK = "concat('$', CAST(octet_length(encode({0})) AS VARCHAR), chr(13), chr(10), {0}, chr(13), chr(10))"
_LIVE = f"WITH {LOG}, {LATEST} SELECT key, value FROM latest WHERE op = 1"

ORACLES = ORACLES | {
    "live_semi": _LIVE, "live_struct": _LIVE, "full_compaction": _LIVE,
    "point_get": _LIVE + " AND key = '7'", "bounded_scan": _LIVE + " AND key >= '2' AND key < '7'", "prefix_scan": _LIVE + " AND key LIKE '1%'",
    "run_foreach": f"WITH {LOG}, {RUNS} SELECT run, key, op, value FROM runs",
    "memory_snapshot": f"WITH {LOG}, {RUNS} SELECT key, op, value FROM runs WHERE run = 7",
    "compaction_invariant": f"WITH {LOG}, {LATEST} SELECT COUNT(*) AS before, COUNT(*) AS after, 0 AS differences FROM latest WHERE op = 1",
    "block_cut": f"WITH RECURSIVE {LOG}, {RUNS}, {_CUT} SELECT run, key, block FROM c",
    "block_index": f"WITH RECURSIVE {LOG}, {RUNS}, {_CUT} SELECT run, block, MAX(key) AS last_key, MIN(pos) AS \"offset\", SUM(size) AS bytes FROM c GROUP BY run, block",
    "index_lookup": f"WITH RECURSIVE {LOG}, {RUNS}, {_CUT} SELECT run, MIN(block) AS block FROM (SELECT run, block, MAX(key) AS k FROM c GROUP BY run, block) x WHERE k >= '5' GROUP BY run",
    "bloom_hash": f"SELECT key, {_HASH} AS h FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events) t",
    "bloom_may_match": f"""WITH {LOG}, {RUNS}, n AS (SELECT run, CAST(FLOOR((GREATEST(COUNT(*) * 10, 64) + 7) / 8) AS BIGINT) * 8 AS bits FROM runs GROUP BY run),
f AS (SELECT DISTINCT run, unnest({_BITS}) AS bit FROM (SELECT r.run, bits, {_HASH} AS h FROM runs r JOIN n ON n.run = r.run) x),
p AS (SELECT run, key, unnest({_BITS}) AS bit FROM (SELECT n.run, bits, key, {_HASH} AS h FROM {_CUSTOMERS} c, n) x)
SELECT p.run, p.key, bool_and(f.bit IS NOT NULL) AS maybe FROM p LEFT JOIN f ON f.run = p.run AND f.bit = p.bit GROUP BY p.run, p.key""",
    "wal_replay": f"WITH {LOG} SELECT key, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY seq % 16 DESC, seq DESC) AS rn FROM log) t WHERE rn = 1 AND op = 1",
    "resp_array_reply": f"""WITH {LOG}, {LATEST}, e AS (SELECT key, {_BULK.format("key")} || {_BULK.format("value")} AS f FROM latest WHERE op = 1 AND key >= '3') SELECT concat('*', CAST(2 * COUNT(*) AS VARCHAR), chr(13), chr(10), string_agg(f, '' ORDER BY key)) AS reply FROM e""",
    "resp_encoders": f"""SELECT n_nationkey, concat('+', n_name, chr(13), chr(10)) AS simple, concat('-ERR ', n_name, chr(13), chr(10)) AS error, concat(':', CAST(n_nationkey AS VARCHAR), chr(13), chr(10)) AS integer, {_BULK.format("n_name")} AS bulk, concat('$-1', chr(13), chr(10)) AS null_bulk, concat('*2', chr(13), chr(10), {_BULK.format("n_name")}, {_BULK.format("CAST(n_regionkey AS VARCHAR)")}) AS array FROM nation""",
    "memtable_rotation": f"""WITH RECURSIVE {LOG}, w(seq, epoch, keys) AS (SELECT seq, 0, [key] FROM log WHERE seq = 0
UNION ALL SELECT l.seq, CASE WHEN len(w.keys) >= 100 THEN w.epoch + 1 ELSE w.epoch END, CASE WHEN len(w.keys) >= 100 THEN [l.key] WHEN list_contains(w.keys, l.key) THEN w.keys ELSE list_append(w.keys, l.key) END FROM log l JOIN w ON l.seq = w.seq + 1) SELECT seq, epoch FROM w""",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir)
