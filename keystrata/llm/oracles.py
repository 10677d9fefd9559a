"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in the tests."""

from __future__ import annotations

from . import line_dedup, mixing, quality, url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_HOST = _LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")
_URL = f"""u AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, html, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)"""

OP2 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, list_reduce(list_concat([''], [substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4) FOR c IN string_split(x, '')]), lambda a, y: a || y) AS bits FROM d),
e AS (SELECT *, list_reduce(list_concat([''], [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1) FOR i IN range(32)]), lambda a, y: a || y) AS payload_digest, max(page_id) OVER (PARTITION BY x) AS chief FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = chief THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> chief THEN chief END AS refers_to, CASE WHEN page_id = chief THEN TRUE END AS verified FROM e"""

_QUOTED = quality.ENDINGS.replace("'", "''")
OP3 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_SPACED}) AS w, string_split(text, chr(10)) AS lines FROM t),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a) AS n FROM (SELECT r, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) || ' ' || list_extract(w, i + 3) || ' ' || list_extract(w, i + 4) AS a FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5) x) y),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS q FROM g WHERE n > 1) x GROUP BY r),
l AS (SELECT r, unnest(lines) AS line FROM w),
f AS (SELECT r, line, len(regexp_extract_all(line, {_SPACED})) AS n, len(regexp_extract_all(line, '!!+|{quality.SYMBOLS}+')) AS noise, len(regexp_extract_all(line, '[|»›·•]')) AS seps, right(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), 1) AS tail FROM l),
j AS (SELECT r, n, line, n > 0 AND (noise * 100 > n * {quality.NOISE_PERCENT} OR (n >= 5 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}')) OR (n < {quality.NAVIGATION_WORDS} AND NOT contains('{_QUOTED}', tail)) OR (seps >= 3 AND seps * 100 > n * {quality.NOISE_PERCENT}) OR regexp_matches(line, '{quality.BOILERPLATE}')) AS bad FROM f),
s AS (SELECT r, coalesce(sum(CASE WHEN bad THEN n END), 0) AS lost_words, count(CASE WHEN n > 0 THEN 1 END) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS n_dup_lines FROM j GROUP BY r),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(lost_words AS BIGINT) AS lost_words FROM w LEFT JOIN c USING (r) LEFT JOIN s USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_words * 100 <= n_words * {quality.LOSS_PERCENT} AS kept FROM v"""

OP5 = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM t WHERE len(w) >= 5 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t JOIN c ON c.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.BASE_RULES)
_HOSTS = ", ".join(f"('{h}', '{p}')" for h, p, _ in url_filter.OWN_RULES if not h.startswith("~"))
_WORDS = ", ".join(f"'{h[1:]}'" for h, _, _ in url_filter.OWN_RULES if h.startswith("~"))
OP8 = f"""WITH {_URL}, rules(rh, rp, rv) AS (VALUES {_RULES}), own(oh, op) AS (VALUES {_HOSTS}),
m AS (SELECT page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC, length(rh) DESC, rv DESC) AS k FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.rv, CASE WHEN p.host <> '' AND (list_has_any(regexp_split_to_array(p.host, '[.-]'), [{_WORDS}]) OR EXISTS (SELECT 1 FROM own WHERE (oh = '' OR p.host = oh OR ends_with(p.host, '.' || oh)) AND starts_with(p.path, op))) THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.host = p.host AND m.path = p.path AND m.k = 1"""

OP9 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_PLAIN}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_PLAIN}) AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, k, g FROM (SELECT item_id, least(10, len(w)) AS k, unnest([array_to_string(w[i : i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS g FROM b WHERE len(w) > 0) x),
z AS (SELECT DISTINCT k FROM q),
v AS (SELECT doc_id, k, unnest([{{'i': i, 'g': array_to_string(w[i : i + k - 1], ' ')}} FOR i IN range(1, len(w) - k + 2)]) AS x FROM d, z WHERE len(w) >= k),
h AS (SELECT doc_id, item_id, v.k AS k, x.i AS i FROM v JOIN q ON q.k = v.k AND q.g = x.g),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) x GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

_TAGS = line_dedup.BLOCK_TAGS
OP7 = f"""WITH {_URL}, t AS (SELECT page_id, host, row_number() OVER () AS r, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', chr(10), 'g'), '{_TAGS}', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM p),
l AS (SELECT page_id, host, r, list_filter([trim(y, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) FOR y IN string_split(x, chr(10))], lambda y: y <> '') AS lines FROM t),
n AS (SELECT host, count(*) AS host_pages FROM l GROUP BY host),
c AS (SELECT host, y, count(*) AS pages FROM (SELECT host, unnest(list_distinct(lines)) AS y FROM l) x GROUP BY host, y),
b AS (SELECT c.host, list(y) AS bad FROM c JOIN n ON n.host = c.host WHERE pages >= {line_dedup.LEAST_PAGES} AND pages > CAST({line_dedup.RATIO} AS DOUBLE) * host_pages GROUP BY c.host),
k AS (SELECT page_id, l.host, lines, list_filter(lines, lambda y: NOT list_contains(coalesce(bad, []), y)) AS kept FROM l LEFT JOIN b ON b.host = l.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS kept_text FROM k"""

_FIT = "coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
_TIME = "2 * share{0} / (1.0 - slope / 2 + sqrt((1.0 - slope / 2) * (1.0 - slope / 2) + 2 * slope * share{0}))"
OP10 = f"""WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size, row_number() OVER () AS r FROM documents),
d AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || CAST(size AS VARCHAR)) AS key FROM z),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][1 + CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT)] AS weight, CAST(sum(source_size) OVER () AS DOUBLE) AS goal FROM s),
v AS (SELECT *, (goal - {mixing.MOST} * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / CAST(sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM w),
h AS (SELECT lev AS level FROM v WHERE lev * weight <= {mixing.MOST} * source_size ORDER BY source_size / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, weight, CASE WHEN coalesce(level * weight > {mixing.MOST} * source_size, TRUE) THEN CAST({mixing.MOST} * source_size AS DOUBLE) ELSE level * weight END AS target FROM v LEFT JOIN h ON TRUE),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds, target - CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END * source_size AS room FROM t),
a AS (SELECT d.*, p.source_size, p.weight, p.target, p.rounds, p.room FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, {_FIT} AS upto FROM a),
l AS (SELECT source AS ls, max(room) - coalesce(sum(CASE WHEN upto <= room THEN size END), 0) AS gap FROM b GROUP BY source),
o AS (SELECT b.*, l.gap FROM b JOIN l ON b.source IS NOT DISTINCT FROM l.ls WHERE upto > room AND size > 0),
q AS (SELECT *, {_FIT} AS again FROM o WHERE size <= gap),
c AS (SELECT r, source, size FROM q WHERE again <= gap),
g AS (SELECT ls, max(gap) - coalesce(sum(c.size), 0) AS gap FROM l LEFT JOIN c ON c.source IS NOT DISTINCT FROM ls GROUP BY ls),
f AS (SELECT r FROM (SELECT o.r, row_number() OVER (PARTITION BY o.source ORDER BY abs(g.gap - o.size), o.size, o.key, o.doc_id, o.r) AS k FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.ls WHERE o.r NOT IN (SELECT r FROM c) AND abs(g.gap - o.size) < g.gap) x WHERE k = 1),
m AS (SELECT *, CASE WHEN source_size > 0 THEN least({mixing.MOST}, rounds + CASE WHEN upto <= room OR r IN (SELECT r FROM c) OR r IN (SELECT r FROM f) THEN 1 ELSE 0 END) ELSE 0 END AS copies, CAST(weight - 2 AS DOUBLE) * 0.5 AS slope FROM b),
e AS (SELECT *, least(1.0, (0 * source_size + upto - size / 2) / greatest(target, 1.0)) AS share0, least(1.0, (1 * source_size + upto - size / 2) / greatest(target, 1.0)) AS share1, least(1.0, (2 * source_size + upto - size / 2) / greatest(target, 1.0)) AS share2 FROM m)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CASE WHEN copies > 0 THEN {_TIME.format(0)} END AS position, CASE WHEN copies > 1 THEN {_TIME.format(1)} END AS position_2, CASE WHEN copies > 2 THEN {_TIME.format(2)} END AS position_3 FROM e"""

ORACLES = {"op2_warc_archive": OP2, "op3_quality_rules": OP3, "op5_near_dedup": OP5, "op7_site_line_dedup": OP7, "op8_url_filter": OP8, "op9_decontaminate": OP9, "op10_mix_sources": OP10}
