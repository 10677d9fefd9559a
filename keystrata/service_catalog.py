"""Registered queries of the command layer, recovery and native filters over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _BITS, _BULK, _HASH, _LIVE, _levels, _probes, mutation_log, table
from .functions import bloom, codec
from .model import ADD_RUN, ADD_WAL, DROP_RUN, DROP_WAL, VALUE
from .operators import protocol, recovery, visibility
from .oracles import LOG, RUNS


def rscan_reverse_page(spark, sf_dir):
    """The last 25 pairs below a bound, from the greatest key down."""
    return visibility.scan_from(mutation_log(spark, sf_dir), "1", "9", limit=25, reverse=True)


def physical_delete(spark, sf_dir):
    """The log without a trace of one customer in seven."""
    return visibility.erase(mutation_log(spark, sf_dir), _probes(spark, sf_dir).where(F.col("key").cast("long") % 7 == 0))


def command_batch(spark, sf_dir):
    """(log, commands): customers' names as the old log; every event as a command of its user's key, five scans among them."""
    log = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("key"), F.lit(VALUE).cast("byte").alias("op"), F.col("c_name").alias("value"))
    kind, key, none = F.col("event_type"), F.col("user_id").cast("string"), F.lit(0).cast("long").alias("generation")
    argv = F.when(kind == "click", F.array(F.lit("set"), key, F.col("props"))).when(kind == "error", F.array(F.lit("DEL"), key)).when(kind == "signup", F.array(F.lit("PING"))).otherwise(F.array(F.lit("GET"), key))
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("conn_id"), none, (2 * F.col("event_id")).alias("req_seq"), argv.alias("argv"))
    place = (402 * F.col("r_regionkey") + 1).cast("long")
    scans = table(spark, sf_dir, "region").select(F.lit(99).cast("long").alias("conn_id"), none, place.alias("req_seq"), F.array(F.lit("RSCAN"), F.concat(F.lit("9"), (5 + F.col("r_regionkey")).cast("string"))).alias("argv"))
    return log, events.unionByName(scans)


def command_replies(spark, sf_dir):
    replies = protocol.execute(*command_batch(spark, sf_dir))[1]
    return replies.select("conn_id", "req_seq", "reply")


def command_effects(spark, sf_dir):
    """What is visible after the batch."""
    return visibility.live(protocol.execute(*command_batch(spark, sf_dir))[0]).select("key", "value")


def request_stream(spark, sf_dir):
    """Requests of sixteen connections in pieces of uneven length; one in 97 is damaged, which ends its connection."""
    words = codec.array(F.array("event_type", F.col("user_id").cast("string"), "props"))
    text = F.when(F.col("event_id") % 97 == 96, F.lit("+NOTARRAY\r\n")).otherwise(words)
    cut = (F.col("event_id") % 17).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("half"), F.substring(text, F.lit(1), cut).alias("t")), F.struct(F.lit(1).alias("half"), F.substring(text, cut + 1, F.length(text)).alias("t")))
    pieces = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("conn_id"), "event_id", F.explode(halves).alias("p"))
    return pieces.select("conn_id", (2 * F.col("event_id") + F.col("p.half")).alias("piece"), F.encode("p.t", "UTF-8").alias("data"))


def resp_requests(spark, sf_dir):
    got = protocol.parse_requests(request_stream(spark, sf_dir))
    return got.select("conn_id", "req_seq", F.array_join("argv", "|").alias("argv"), "error")


def _listing(spark, sf_dir):
    """Names as a folder could hold them: runs, logs, other files and stems that are no numbers."""
    key = F.col("c_custkey")
    end = F.when(key % 5 < 2, ".sst").when(key % 5 < 4, ".wal").otherwise(".tmp")
    return table(spark, sf_dir, "customer").select(F.concat(F.when(key % 11 == 0, "x").otherwise(""), key.cast("string"), end).alias("name"))


def _metadata(spark, sf_dir):
    """Edits of runs and logs from orders: fulfilled ones drop, the others add; every third is a log."""
    state, wal = F.col("o_orderstatus"), F.col("o_custkey") % 3 == 0
    op = F.when(wal, F.when(state == "F", DROP_WAL).otherwise(ADD_WAL)).otherwise(F.when(state == "F", DROP_RUN).otherwise(ADD_RUN))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edit_seq"), op.alias("op"), F.col("o_custkey").alias("id"), F.when(wal, None).when(state == "O", 0).otherwise(1).cast("long").alias("level"))


def recovery_runs(spark, sf_dir):
    return recovery.runs_to_open(recovery.fold_edits(_metadata(spark, sf_dir)), recovery.numbered_files(_listing(spark, sf_dir)))


def recovery_fallback(spark, sf_dir):
    """Without any run in the metadata every run on disk is one of level 0."""
    state = recovery.fold_edits(_metadata(spark, sf_dir).where(F.col("op").isin(ADD_WAL, DROP_WAL)))
    return recovery.runs_to_open(state, recovery.numbered_files(_listing(spark, sf_dir)))


def recovery_logs(spark, sf_dir):
    return recovery.logs_to_replay(recovery.fold_edits(_metadata(spark, sf_dir)), recovery.numbered_files(_listing(spark, sf_dir)))


def recovery_next_number(spark, sf_dir):
    return recovery.next_number_from_files(recovery.numbered_files(_listing(spark, sf_dir)))


def metadata_edits_logged(spark, sf_dir):
    """Logs added for even customers and dropped for odd ones: those edits that change the metadata."""
    state = recovery.fold_edits(_metadata(spark, sf_dir))
    proposed = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, ADD_WAL).otherwise(DROP_WAL).alias("op"), F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("level"))
    return recovery.edits_to_log(state, proposed).select("op", "id")


def bloom_filter_data(spark, sf_dir):
    return bloom.packed_filters(bloom.create_filters(_levels(spark, sf_dir)[0])).select("run", F.hex("data").alias("data"))


QUERIES = {
    f.__name__: f
    for f in (
        rscan_reverse_page, physical_delete, command_replies, command_effects, resp_requests, recovery_runs, recovery_fallback, recovery_logs, recovery_next_number, metadata_edits_logged, bloom_filter_data,
    )
}

_COMMANDS = """base AS (SELECT c_custkey AS seq, CAST(c_custkey AS VARCHAR) AS key, 1 AS op, c_name AS value FROM customer),
cmd AS (SELECT user_id % 16 AS conn_id, 2 * event_id AS req_seq, CASE event_type WHEN 'click' THEN 'SET' WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'PING' ELSE 'GET' END AS c, CAST(user_id AS VARCHAR) AS key, props FROM events),
st AS (SELECT key, CAST(-1 AS BIGINT) AS spot, seq, op, value FROM base UNION ALL SELECT key, req_seq, req_seq, CASE c WHEN 'SET' THEN 1 ELSE 2 END, CASE c WHEN 'SET' THEN props ELSE '' END FROM cmd WHERE c IN ('SET', 'DEL'))"""
_META = """meta AS (SELECT id, wal, lvl FROM (SELECT o_custkey AS id, o_custkey % 3 = 0 AS wal, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS lvl, o_orderstatus AS st, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1 AND st <> 'F'),
disk AS (SELECT c_custkey AS id, c_custkey % 5 >= 2 AS wal FROM customer WHERE c_custkey % 5 < 4 AND c_custkey % 11 <> 0)"""
ORACLES = {
    "rscan_reverse_page": _LIVE + " AND key >= '1' AND key < '9' ORDER BY key DESC LIMIT 25",
    "physical_delete": f"WITH {LOG} SELECT seq, key, op, value FROM log WHERE key NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 7 = 0)",
    "command_effects": f"WITH {_COMMANDS} SELECT key, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY spot DESC, seq DESC) AS rn FROM st) t WHERE rn = 1 AND op = 1",
    "command_replies": f"""WITH {_COMMANDS}, scans AS (SELECT 99 AS conn_id, 402 * r_regionkey + 1 AS req_seq, concat('9', CAST(5 + r_regionkey AS VARCHAR)) AS start FROM region),
x AS (SELECT key, spot, seq, op, value, NULL AS conn_id, NULL AS req_seq FROM st UNION ALL SELECT key, req_seq, NULL, NULL, NULL, conn_id, req_seq FROM cmd WHERE c = 'GET'),
g AS (SELECT *, LAST_VALUE(CASE WHEN op IS NOT NULL THEN struct_pack(o := op, v := value) END IGNORE NULLS) OVER (PARTITION BY key ORDER BY spot, seq NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM x),
h AS (SELECT q.conn_id, q.req_seq, s.key, s.value, s.op, ROW_NUMBER() OVER (PARTITION BY q.req_seq, s.key ORDER BY s.spot DESC, s.seq DESC) AS rn FROM scans q JOIN st s ON s.key >= q.start AND s.spot < q.req_seq),
b AS (SELECT req_seq, COUNT(*) AS n, string_agg({_BULK.format("key")} || {_BULK.format("value")}, '' ORDER BY key) AS body FROM h WHERE rn = 1 AND op = 1 GROUP BY req_seq)
SELECT conn_id, req_seq, concat('+OK', chr(13), chr(10)) AS reply FROM cmd WHERE c IN ('SET', 'DEL')
UNION ALL SELECT conn_id, req_seq, concat('-ERR unknown command ''PING''', chr(13), chr(10)) FROM cmd WHERE c = 'PING'
UNION ALL SELECT conn_id, req_seq, CASE WHEN s.o = 1 THEN {_BULK.format("s.v")} ELSE concat('$-1', chr(13), chr(10)) END FROM g WHERE req_seq IS NOT NULL
UNION ALL SELECT q.conn_id, q.req_seq, concat('*', CAST(2 * coalesce(n, 0) AS VARCHAR), chr(13), chr(10), coalesce(body, '')) FROM scans q LEFT JOIN b ON b.req_seq = q.req_seq""",
    "resp_requests": """WITH e AS (SELECT user_id % 16 AS conn_id, event_id, concat(event_type, '|', CAST(user_id AS VARCHAR), '|', props) AS argv, event_id % 97 = 96 AS bad FROM events),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conn_id ORDER BY event_id) - 1 AS req_seq, COALESCE(SUM(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY conn_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad_before FROM e)
SELECT conn_id, req_seq, CASE WHEN NOT bad THEN argv END AS argv, CASE WHEN bad THEN concat('-ERR protocol error', chr(13), chr(10)) END AS error FROM n WHERE bad_before = 0""",
    "recovery_runs": f"WITH {_META} SELECT d.id, CAST(m.lvl AS BIGINT) AS level FROM meta m JOIN disk d ON d.id = m.id AND NOT d.wal AND NOT m.wal",
    "recovery_fallback": f"WITH {_META} SELECT id, CAST(0 AS BIGINT) AS level FROM disk WHERE NOT wal",
    "recovery_logs": f"WITH {_META} SELECT id, bool_or(found) AS found FROM (SELECT id, TRUE AS found FROM disk WHERE wal UNION ALL SELECT id, FALSE FROM meta WHERE wal) x GROUP BY id",
    "recovery_next_number": f"WITH {_META} SELECT MAX(id) AS next_file_number FROM disk",
    "metadata_edits_logged": f"WITH {_META} SELECT CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 5 END AS op, c_custkey AS id FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey IN (SELECT id FROM meta WHERE wal))",
    "bloom_filter_data": f"""WITH {LOG}, {RUNS}, n AS (SELECT run, CAST(FLOOR((GREATEST(COUNT(*) * 10, 64) + 7) / 8) AS BIGINT) * 8 AS bits FROM runs GROUP BY run),
f AS (SELECT DISTINCT run, unnest({_BITS}) AS bit FROM (SELECT r.run, bits, {_HASH} AS h FROM runs r JOIN n ON n.run = r.run) x),
y AS (SELECT run, bit // 8 AS spot, CAST(SUM(1 << CAST(bit % 8 AS INT)) AS INT) AS byte FROM f GROUP BY run, bit // 8),
z AS (SELECT run, unnest(range(bits // 8)) AS spot FROM n)
SELECT z.run, string_agg(printf('%02X', coalesce(byte, 0)), '' ORDER BY z.spot) || '06' AS data FROM z LEFT JOIN y ON y.run = z.run AND y.spot = z.spot GROUP BY z.run""",
}
