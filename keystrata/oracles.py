"""SQL that says what each query of the engine should return, for a check by another engine."""

from __future__ import annotations

LOG = """log AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
CASE WHEN event_type = 'error' THEN '' ELSE props END AS value, CAST(FLOOR(event_id * 8.0E0 / (SELECT COUNT(*) FROM events)) AS INT) AS run FROM events)"""
LATEST = "latest AS (SELECT key, op, value, seq, run FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) t WHERE rn = 1)"
RUNS = "runs AS (SELECT run, key, op, value, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY run, key ORDER BY seq DESC) AS rn FROM log) t WHERE rn = 1)"
L1 = "l1 AS (SELECT key, op, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY run DESC) AS rn FROM runs WHERE run < 5) t WHERE rn = 1)"
L0 = "l0 AS (SELECT key, op, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY run DESC) AS rn FROM runs WHERE run IN (5, 6)) t WHERE rn = 1)"

ORACLES = {
    "live": f"""WITH {LOG}, {LATEST} SELECT key, value FROM latest WHERE op=1""",
    "get_tristate": f"""WITH {LOG}, {LATEST} SELECT p.key, CASE WHEN l.key IS NULL THEN 'absent' WHEN l.op=2 THEN 'tombstone' ELSE 'hit' END AS status FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer) p LEFT JOIN latest l ON p.key=l.key""",
    "rscan_from": f"""WITH {LOG}, {LATEST} SELECT key, value FROM latest WHERE op=1 AND key >= '3'""",
    "rscan_flat": f"""WITH {LOG}, {LATEST}, r AS (SELECT key, value, ROW_NUMBER() OVER (ORDER BY key) AS i FROM latest WHERE op=1 AND key>='3') SELECT 2*i-2 AS pos, key AS element FROM r UNION ALL SELECT 2*i-1 AS pos, value AS element FROM r""",
    "seek_lower_bound": f"""WITH {LOG}, {LATEST} SELECT p.k AS probe, MIN(l.key) AS found FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer) p LEFT JOIN (SELECT key FROM latest WHERE op=1) l ON l.key>=p.k GROUP BY p.k""",
    "iterator_next": f"""WITH {LOG}, {LATEST} SELECT key, LEAD(key) OVER (ORDER BY key) AS next_key FROM latest WHERE op=1""",
    "minor_flush_stats": f"""WITH {LOG}, {RUNS} SELECT run, COUNT(*) AS n, SUM(CASE WHEN op=2 THEN 1 ELSE 0 END) AS tombs, MIN(key) AS min_key, MAX(key) AS max_key FROM runs GROUP BY run""",
    "l0_to_l1_compact": f"""WITH {LOG}, {RUNS}, {L1}, {L0} SELECT key, op, value FROM l0 WHERE op=1 UNION ALL SELECT l0.key, l0.op, '' AS value FROM l0 WHERE op=2 AND EXISTS (SELECT 1 FROM l1 WHERE l1.key=l0.key AND l1.op=1)""",
    "dropped_tombstones": f"""WITH {LOG}, {RUNS}, {L1}, {L0} SELECT key FROM l0 WHERE op=2 AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.key=l0.key AND l1.op=1)""",
    "run_data_bytes": f"""WITH {LOG}, {RUNS} SELECT run, SUM(4+OCTET_LENGTH(ENCODE(key))+1+4+OCTET_LENGTH(ENCODE(value))) AS data_bytes FROM runs GROUP BY run""",
    "bloom_filter_bytes": f"""WITH {LOG}, {RUNS} SELECT run, CAST(FLOOR((GREATEST(COUNT(*)*10,64)+7)/8) AS BIGINT)+1 AS filter_bytes FROM runs GROUP BY run""",
    "wal_corrupt_prefix": """SELECT l_orderkey % 16 AS wal, COUNT(*) AS n FROM lineitem l JOIN (SELECT l_orderkey % 16 AS w, MIN(CASE WHEN l_discount>0.09 THEN l_orderkey*10+l_linenumber END) AS bad FROM lineitem GROUP BY 1) b ON l_orderkey%16=b.w WHERE b.bad IS NULL OR l_orderkey*10+l_linenumber<b.bad GROUP BY 1""",
    "resp_get_reply": f"""WITH {LOG}, {LATEST} SELECT key, CASE WHEN op=1 THEN CONCAT('$',CAST(OCTET_LENGTH(ENCODE(value)) AS VARCHAR),CHR(13),CHR(10),value,CHR(13),CHR(10)) ELSE CONCAT('$-1',CHR(13),CHR(10)) END AS reply FROM latest""",
    "multi_get": f"""WITH {LOG}, {LATEST} SELECT p.k AS key, l.value FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer) p LEFT JOIN (SELECT key, value FROM latest WHERE op=1) l ON l.key = p.k""",
    "level_get": f"""WITH {LOG}, {LATEST} SELECT key, CASE WHEN run=7 THEN 'mem' WHEN run IN (5,6) THEN 'l0' ELSE 'l1' END AS tier, op FROM latest""",
    "manifest_fold": """SELECT id, level FROM (SELECT o_custkey AS id, CASE WHEN o_orderstatus='O' THEN 0 ELSE 1 END AS level, o_orderstatus AS st, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) t WHERE rn=1 AND st<>'F'""",
    "next_file_number": """SELECT o_custkey AS next_file_number FROM (SELECT o_custkey, ROW_NUMBER() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus='P') t WHERE rn=1""",
    "manifest_checkpoint": """SELECT o_orderpriority AS grp, COUNT(*) AS edits, CAST(FLOOR(COUNT(*)/100) AS BIGINT) AS checkpoints, COUNT(*) % 100 AS edits_since FROM orders GROUP BY o_orderpriority""",
    "wal_replay_order": """WITH w AS (SELECT DISTINCT l_suppkey % 16 AS wal FROM lineitem) SELECT wal, ROW_NUMBER() OVER (ORDER BY wal) AS numeric_rank, ROW_NUMBER() OVER (ORDER BY CAST(wal AS VARCHAR)) AS lexical_rank FROM w""",
    "status_metrics": f"""WITH {LOG}, {RUNS} SELECT COUNT(CASE WHEN run=7 THEN 1 END) AS mem_count, COUNT(DISTINCT CASE WHEN run IN (5,6) THEN run END) AS l0_count, COUNT(DISTINCT CASE WHEN run<5 THEN run END) AS l1_count, COUNT(CASE WHEN run=7 THEN 1 END) * 128 AS approx_mem_bytes FROM runs""",
    "reply_order_prefix": """WITH r AS (SELECT user_id AS conn_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS req_seq, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS done FROM events), g AS (SELECT conn_id, MIN(CASE WHEN done=0 THEN req_seq END) AS gap FROM r GROUP BY conn_id) SELECT r.conn_id, COUNT(*) AS emittable FROM r JOIN g ON r.conn_id=g.conn_id WHERE g.gap IS NULL OR r.req_seq < g.gap GROUP BY r.conn_id""",
    "generation_fence": """WITH cur AS (SELECT user_id % 16 AS fd, MAX(user_id) AS generation FROM events GROUP BY user_id % 16) SELECT e.event_id, e.user_id % 16 AS fd FROM events e WHERE EXISTS (SELECT 1 FROM cur WHERE cur.fd = e.user_id % 16 AND cur.generation = e.user_id)""",
    "dispatch_validate": """WITH a AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'SET' WHEN 'error' THEN 'del' WHEN 'purchase' THEN 'RScan' ELSE 'ping' END AS cmd, 1 + event_id % 3 AS argc FROM events), n AS (SELECT *, CASE UPPER(cmd) WHEN 'SET' THEN 3 WHEN 'GET' THEN 2 WHEN 'DEL' THEN 2 WHEN 'RSCAN' THEN 2 END AS want FROM a) SELECT event_id, CASE WHEN want IS NULL THEN CONCAT('unknown command ''', cmd, '''') WHEN argc <> want THEN CONCAT('wrong number of arguments for ''', UPPER(cmd), ''' command') ELSE 'ok' END AS verdict FROM n""",
    "batch_point_in_time_get": f"""WITH {LOG} SELECT seq, key, CASE WHEN pop=1 THEN pval END AS got FROM (SELECT seq, key, LAST_VALUE(op) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pop, LAST_VALUE(value) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pval FROM log) t""",
}
