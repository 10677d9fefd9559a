import collections
import re
import zlib

import pytest
from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keystrata.llm import decontam as decontam_module
from keystrata.llm import license_scan, near_dedup, quality, tokens
from keystrata.llm.decontam import find_contamination
from keystrata.llm.license_scan import scan_licenses
from keystrata.llm.line_dedup import site_line_dedup
from keystrata.llm.mixing import curriculum, mix, placements
from keystrata.llm.near_dedup import near_duplicates
from keystrata.llm.quality import judge
from keystrata.llm.queries import default_tokenizer
from keystrata.llm.sharding import shard_documents
from keystrata.llm.url_filter import judge_urls, rule_table
from keystrata.llm.warc import page_records, read_warc, write_pages

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n long, rank long, row long, id long, quality string, word string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PROSE = " ".join(f"w{i}" for i in range(60)) + "."


def words(text, spaced=True):
    return re.findall(r"[^\x20\x09-\x0D]+" if spaced else r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    texts = [None, "", " \n\t", "one", "Two words", PROSE, PROSE, PROSE.replace("w30", "x"), "long " * 60_000, "x" * 300_000, "é ñ z\n\n", "All  rights\nreserved. CC BY", PROSE]
    rows = [(i, t, f"s{i % 3}", 1, 1, 1, 1, "q", "w") for i, t in enumerate(texts)]
    rows += [(5, PROSE, "s0", 1, 1, 1, 1, "q", "w"), (None, PROSE, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, "other text here", "s1", 1, 1, 1, 1, "q", "w")]
    return spark.createDataFrame(rows, DOCS), [(r[0], r[1], r[2]) for r in rows]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(rows, percent, width=5):
    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: root(i) for i, _ in sets}


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows_of(entry.queries()[name](spark, SF)) == sql_rows(SF, entry.LLM_ORACLES[name])


def test_near_duplicates_on_odd_rows(spark):
    docs, rows = odd_docs(spark)
    got = near_duplicates(docs, percent=80).collect()
    want = components(rows, 80)
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.id] and r.kept == (r.id == want[r.id]) for r in got if r.id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.id is None)
    assert near_duplicates(empty(spark)).count() == 0


def test_near_copies_of_one_original_are_one_group(spark):
    import random

    r = random.Random(5)
    original = [f"v{i}" for i in range(300)]
    rows = [(0, " ".join(original), "s")]
    for i in range(1, 200):
        copy = list(original)
        for _ in range(4):
            copy[r.randrange(300)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(copy), "s"))
    rows += [(1000 + i, " ".join(f"z{i}_{k}" for k in range(50)), "s") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {x.id: x.component_id for x in near_duplicates(docs, percent=85).collect()} == components(rows, 85)


def test_forest_depth_follows_the_threshold():
    for percent in (50, 60, 80, 85, 95):
        depth = near_dedup.depth_for(percent)
        assert (1 - (percent / 100) ** depth) ** 16 < 2e-5 and 1 <= depth <= 4
    assert [near_dedup.depth_for(p) for p in (50, 80, 85)] == [1, 3, 4]


def templated(n):
    """A form of ten slots: any two copies are at 0.845, but in each pair two slots are alike, which makes it 0.874."""
    import random

    r = random.Random(11)
    rows = []
    for i in range(n):
        copy = [f"v{k}" for k in range(600)]
        for k in range(10):
            copy[30 + 55 * k] = f"n{i // 2 if k < 2 else i}_{k}_{k < 2}"
        rows.append((r.randrange(10**9), " ".join(copy), "s"))
    return rows


def test_near_duplicates_of_a_template_equal_brute_force(spark):
    rows = templated(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {x.id: x.component_id for x in near_duplicates(docs, percent=85).collect()} == components(rows, 85)


def test_links_that_the_forest_misses_are_found_by_prefixes(spark, monkeypatch):
    """Without candidates of the forest's neighbours, crowded regions are still decided exactly."""
    monkeypatch.setattr(near_dedup, "NEAR", 0)
    monkeypatch.setattr(near_dedup, "forest_candidates", lambda members: members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("a < b"))
    rows = templated(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {x.id: x.component_id for x in near_duplicates(docs, percent=85).collect()} == components(rows, 85)


def test_prefix_candidates_lose_no_pair(spark, tmp_path):
    import random

    from keystrata.llm._store import Scratch

    r = random.Random(4)
    pool, sets = list(range(1, 4000)), []
    for i in range(150):
        s = set(r.sample(pool, r.randrange(1, 120))) if i % 3 == 0 else {x for x in sets[-1] if r.random() < 0.93} | set(r.sample(pool, r.randrange(0, 6)))
        sets.append(s or {1})
    salt = 0x9E3779B97F4A7C15
    as_hashes = lambda s: sorted((x * salt % 2**64) - 2**63 for x in s)
    rows = [(i, i % 40, as_hashes(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "rep long, component long, shingles array<long>")
    for percent in (50, 80, 85, 100):
        got = {(p.a, p.b) for p in near_dedup.prefix_candidates(df.repartition(3), percent, Scratch(spark, "t")).collect()}
        want = {(i, j) for j in range(150) for i in range(j) if i % 40 != j % 40 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        assert want <= got and len(want) > (10 if percent < 100 else -1)


def test_forest_pairs_all_of_a_small_region(spark):
    rows = [(i, *([i // 4 * (1 << 40)] * 32)) for i in range(400)]
    classes = spark.createDataFrame(rows, "rep long, " + ", ".join(f"{k} long" for k in near_dedup.KEYS))
    from keystrata.llm._store import Scratch

    members = near_dedup.forest_members(classes.repartition(7), 3, Scratch(spark, "t"))
    found = {(p.a, p.b) for p in near_dedup.forest_candidates(members).collect()}
    assert {(i, j) for i in range(400) for j in range(i + 1, 400) if i // 4 == j // 4} == found and near_dedup.centre_candidates(members).count() == 0


def test_components(spark, monkeypatch):
    import random

    from keystrata.llm import components as cc
    from keystrata.llm._store import Scratch

    r = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(400), 1000 + r.randrange(400)) for _ in range(260)] + [(5, None), (7, 7), (None, None)]
    parent = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    want = {x: root(x) for x in parent if root(x) != x}
    links = spark.createDataFrame(edges, "u long, v long")
    assert {x.node: x.component for x in cc.connected_components(links, Scratch(spark, "t")).collect()} == want
    with_rounds = cc.connected_components(links.repartition(9), Scratch(spark, "t2"))
    assert {x.node: x.component for x in with_rounds.collect()} == want


def test_decontamination(spark):
    docs, rows = odd_docs(spark)
    items = [(1, " ".join(f"w{i}" for i in range(20, 35))), (2, "Two, WORDS!"), (3, None), (None, "one"), (3, "long long long long long long long long long long long"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in find_contamination(docs, bench).collect())
    want = collections.Counter()
    for i, t, _ in rows:
        w, hit, named = words(t, False), set(), set()
        for item, x in items:
            q = words(x, False)
            k = min(10, len(q))
            grams = {tuple(q[s : s + k]) for s in range(len(q) - k + 1)} if k else set()
            for p in range(len(w) - k + 1) if k else []:
                if tuple(w[p : p + k]) in grams:
                    hit.update(range(p, p + k))
                    named |= {str(item)} if item is not None else set()
        want[(i, len(w), len(hit), tuple(sorted(named)))] += 1
    assert got == want
    run = find_contamination(docs, bench).where("id = 5").first().matches
    assert [(m["item"], m["doc_word"], m["item_word"], m["words"]) for m in run] == [("1", 20, 0, 15)]
    assert find_contamination(empty(spark), bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_equal_words_against_an_item_that_repeats_them(spark):
    import tracemalloc

    from keystrata.llm import decontam

    bench = decontam.Benchmark([1, 2], ["long " * 400, "long long"], 10)
    tracemalloc.start()
    found = list(decontam._hits(bench, 10, decontam.pa.array(["long " * 200_000 + "x", "short"])))
    runs = decontam._runs(*found[0][4:], bench)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert found[0][3].tolist() == [200_000, 0] and len(runs[0]) == 2 and sorted(runs[4].tolist()) == [200_000, 200_000]


def test_clean_rows_keep_their_columns(spark, monkeypatch):
    docs, _ = odd_docs(spark)
    bench = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 12))) for i in range(40)] + [(99, "Two words")], "item_id long, text string")
    hit = {r.id for r in find_contamination(docs.drop("id").withColumnRenamed("row", "id"), bench).where("n_hit > 0").collect()}
    clean = decontam_module.drop_contaminated(docs, bench)
    assert clean.schema == docs.schema and hit
    whole = sorted(map(str, clean.collect()))
    want = find_contamination(docs, bench).where("n_hit = 0")
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(r.id for r in want.collect())
    monkeypatch.setattr("keystrata.llm.decontam.SLICE_BYTES", 600)
    assert sorted(map(str, decontam_module.drop_contaminated(docs, bench).collect())) == whole
    assert decontam_module.drop_contaminated(empty(spark), bench).count() == 0


def test_decontamination_in_slices(spark, monkeypatch):
    docs, _ = odd_docs(spark)
    bench = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 12))) for i in range(40)] + [(99, "Two words")], "item_id long, text string")
    whole = {(r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in find_contamination(docs, bench).collect()}
    monkeypatch.setattr("keystrata.llm.decontam.SLICE_BYTES", 600)
    assert {(r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in find_contamination(docs, bench).collect()} == whole


def test_quality(spark):
    docs, rows = odd_docs(spark)
    got = judge(docs)
    assert got.columns.count("quality") == 1 and got.count() == len(rows)
    by = {r.text: r.quality for r in got.collect()}
    assert by[None].n_words == 0 and by[None].base_failed and by[None].clean_text is None
    assert by[PROSE].kept and by[PROSE].clean_text == PROSE and by[PROSE].n_repeat_words == 0
    assert by["long " * 60_000].n_repeat_words == 60_000 and not by["long " * 60_000].kept
    assert judge(empty(spark)).count() == 0
    menu = "Home | About | Contact | Press\n" + PROSE + "\nCLICK NOW TO BUY THINGS TODAY\nRead our privacy policy here today.\nLogin"
    r = judge(spark.createDataFrame([(menu,)], "text string")).first().quality
    assert r.clean_text == PROSE and r.kept and r.lost_words == 7 + 6 + 6 + 1


def test_license_scan(spark):
    docs, rows = odd_docs(spark)
    got = {r.id: r for r in scan_licenses(docs).collect()}
    assert len(scan_licenses(docs).collect()) == len(rows) and scan_licenses(empty(spark)).count() == 0
    r = got[11]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (5, 2, 0, 3, "cc-by,reserved") and set(r.labels.split(",")) >= {"cc-by", "reserved"}
    assert got[0].n_words == 0 and got[0].labels == "" and got[0].score == 0.0 and got[0].first_word is None
    find = lambda t: [x[3] for x in license_scan.detect(t)]
    assert find("licensed under the apache license, version 2.0.") == ["apache-2.0"]
    assert find("spdx-license-identifier: gpl-3.0-or-later") == ["gpl-3.0"]
    assert find("under the gnu general public license, version 3.") == ["gpl-3.0"]
    assert find("licensed under cc by-nc 4.0.") == ["cc-by-nc"]
    assert find("permit limits smith") == [] and len(license_scan.rules()) > 250
    assert license_scan.resolve([(0, 9, 1, "a", 0.5), (2, 5, 1, "b", 0.5), (2, 5, 3, "c", 1.0), (0, 9, 1, "a", 0.5)]) == [(0, 9, 1, "a", 0.5), (2, 5, 3, "c", 1.0)]


def alternatives(pattern, r):
    """Texts of an expression, such that every branch occurs; ``r`` chooses among the rest."""
    from re import _constants as c
    from re import _parser

    def some(op, arg):
        if op is c.LITERAL:
            return [chr(arg)]
        if op is c.IN:
            kind, value = r.choice([x for x in arg if x[0] is not c.NEGATE])
            return [" " if kind is c.CATEGORY else chr(value if kind is c.LITERAL else r.randint(*value))]
        if op is c.BRANCH:
            return [t for x in arg[1] for t in every(x)]
        if op is c.SUBPATTERN:
            return every(arg[3])
        if op is c.MAX_REPEAT:
            return [""] * (arg[0] == 0) + ["".join(r.choice(every(arg[2])) for _ in range(arg[0]))] * (arg[0] > 1) + every(arg[2]) * (arg[0] < 2)
        return ["/"] if op is c.ANY else [""]

    def every(items):
        texts = [""]
        for op, arg in items:
            more = some(op, arg)
            texts = [t + m for t in texts for m in more]
            if len(texts) > 400:
                texts = r.sample(texts, 400)
        return texts

    return every(_parser.parse(pattern))


def test_license_prefilter_drops_nothing():
    import random

    r = random.Random(2)
    some = lambda t: r.sample(t, min(40, len(t)))
    texts = ["licensed under the creative commons attribution 4.0 international license", "png reference library license", "creative commons attribution-sharealike 3.0"]
    texts += [f"x {t} y" for rule in license_scan.rules() for t in some(alternatives(rule.pattern.pattern, r))]
    every = license_scan.rules()
    matched = set()
    for t in texts:
        found = [(m.start(), m.end(), x.priority, x.label, x.confidence) for x in every for m in x.pattern.finditer(t)]
        matched |= {x[3] for x in found}
        assert license_scan.detect(t) == license_scan.resolve(found), t
    assert matched == {x.label for x in every}
    assert "cc-by-4.0" in [x[3] for x in license_scan.detect(texts[0])] and "libpng" in [x[3] for x in license_scan.detect(texts[1])]


def test_license_query_against_brute_force(spark):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    every = license_scan.rules()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in rows] + [(10**6 + i, t) for i, t in enumerate(["CC, by/CC by", "general public license", "all rights  RESERVED all rights reserved", "cc\xe9 by cc by2 ccby", "Redistributions in binary form must reproduce the above copyright notice, cc by", "x all rights reserved " * 3000])]
    got = {r.doc_id: r for r in entry.queries()["op1_license_scan"](spark, SF).collect()}
    got |= {r.id: r for r in scan_licenses(spark.createDataFrame(rows[-6:], "doc_id long, text string")).collect()}
    for i, text in rows:
        w = words(text, False)
        places = sorted((p, label) for label, q in phrases.items() for p in range(len(w)) if w[p : p + len(q)] == q)
        lowered = (text or "").translate(LOWER)
        found = license_scan.resolve([(m.start(), m.end(), x.priority, x.label, x.confidence) for x in every for m in x.pattern.finditer(lowered)] if len(lowered) < 20_000 else license_scan.detect(lowered))
        base = {label for _, label in places}
        want = (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {x[3] for x in found})))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want and 0 <= r.score <= 1 and (r.score > 0) == bool(want[5])


def pages(spark):
    rows = [(1, "http://A.example.com/en/1?x=1", "<p>same</p>"), (5, "https://b.org/", "<p>same</p>"), (3, None, None), (4, "no scheme", ""), (7, "http://spam-farm.example.net", "x\r\n\r\ny"), (None, "http://h/\r\nX: y", "<p>same</p>"), (5, "https://b.org/", "<p>same</p>"), (9, "://x.fr#a", "z" * 300_000)]
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "page_id long, url string, html string, host string, digest long, salt int")


def test_warc_round_trip(spark, tmp_path):
    write_pages(pages(spark), str(tmp_path / "w"))
    rows = read_warc(spark, str(tmp_path / "w"))
    got = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in rows.collect())
    same = b"<p>same</p>"
    assert [g[:4] for g in got if g[3] == len(same)] == [("urn:page:1", "revisit", "urn:page:5", 11), ("urn:page:5", "response", None, 11), ("urn:page:5", "response", None, 11), ("urn:page:null", "revisit", "urn:page:5", 11)]
    assert {g[0]: (g[1], g[2]) for g in got if g[3] == 0} == {"urn:page:3": ("revisit", "urn:page:4"), "urn:page:4": ("response", None)}
    assert {g[0]: g[4] for g in got if g[0] in ("urn:page:7", "urn:page:9")} == {"urn:page:7": b"x\r\n\r\ny", "urn:page:9": b"z" * 300_000}
    only = rows.where("record_type = 'revisit' and refers_to = 'urn:page:5'")
    assert only.count() == 2
    assert page_records(pages(spark)).count() == 8
    write_pages(pages(spark).limit(0), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
    # a second append keeps the first, and long headers and large payloads are read in pieces
    import base64
    import hashlib

    long = spark.createDataFrame([(20, "http://x.org/" + "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(400)), "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)))], "page_id long, url string, html string")
    write_pages(long, str(tmp_path / "w"))
    again = read_warc(spark, str(tmp_path / "w"))
    assert again.count() == 9 and again.where("record_id = 'urn:page:20'").first().payload.decode() == long.first().html and again.where("record_id = 'urn:page:20'").first().target_uri == long.first().url
    measured = again.where("record_type = 'response'").collect()
    assert all(r.measured_bytes == r.payload_bytes == len(r.payload) and r.measured_digest == r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() for r in measured)
    names = "record_id string, record_type string, target_uri string"
    assert read_warc(spark, str(tmp_path / "w"), names).where("record_id in ('urn:page:20', 'urn:page:9')").count() == 2


def test_foreign_warc(spark, tmp_path):
    import gzip

    record = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    data = [record("warcinfo", b"a: b\r\n\r\n"), record("resource", b"q" * 200_000), record("metadata", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    rows = read_warc(spark, str(tmp_path))
    assert sorted((r.record_type, r.content_length, len(r.payload)) for r in rows.collect()) == sorted([("warcinfo", 8, 8), ("resource", 200_000, 200_000), ("metadata", 0, 0)] * 2)
    assert rows.where("record_type in ('metadata', 'warcinfo')").count() == 4
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.warc").write_bytes(data[0] + data[1].replace(b"200000", b"many") + data[2])
    (tmp_path / "bad" / "d.warc").write_bytes(data[2] + b"x" * 3_000_000)
    assert sorted(r.record_type for r in read_warc(spark, str(tmp_path / "bad")).collect()) == ["metadata", "warcinfo"]


def test_url_rules(spark):
    got = {(r.id, r.host): (r.path, r.rule, r.verdict) for r in judge_urls(pages(spark), rule_table(spark)).collect()}
    assert got[(1, "a.example.com")] == ("/en/1", None, "allow") and got[(5, "b.org")] == ("/", "org/", "allow")
    assert got[(3, "")] == ("", None, "allow") and got[(7, "spam-farm.example.net")] == ("", None, "block")
    assert judge_urls(pages(spark).limit(0), rule_table(spark)).count() == 0
    assert judge_urls(pages(spark), rule_table(spark).limit(0)).count() == 8


def test_url_rules_against_brute_force(spark):
    import random

    r = random.Random(6)
    labels = ["org", "com", "example", "a", "b-c", "spam", "x-spam", "test", "", "xxx", "Ünï"]
    urls = [f"{r.choice(['http', '', 'HTTPS'])}://{'.'.join(r.choice(labels) for _ in range(r.randrange(0, 6)))}{r.choice(['', '/', '/es/', '/en/12', '/fr/x', '/de/', '/cgi-bin/x', '/e'])}{r.choice(['', '?q=/de/', '#://z'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "a://b://c", "http://" + "w." * 30_000 + "org/x", "http://" + "spam." * 20_000 + "net", "http://x.com/" + "p" * 100_000, "http://l\nf.org/\n/x"]
    rules = [("org", "/", "allow"), ("a.org", "/", "block"), ("a", "", "block"), ("", "/e", "block"), ("example.com", "/es/", "allow"), ("org", "/e", "block")]
    own = [("~spam", "", "block"), ("test", "", "block"), ("", "/cgi-bin/", "block")]
    lower = lambda t: t.translate(LOWER)

    def want(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        under = lambda h: h == "" or host == h or host.endswith("." + h)
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and under(h) and path.startswith(p)]
        if fit:
            return host, path, max(fit)[3], max(fit)[4]
        mine = [v for h, p, v in own if host and (h[1:] in re.split("[.-]", host) if h.startswith("~") else under(h)) and path.startswith(p)]
        return host, path, None, mine[0] if mine else "allow"

    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.id: (x.host, x.path, x.rule, x.verdict) for x in judge_urls(docs, rule_table(spark, rules, own)).collect()}
    for i, u in enumerate(urls):
        assert got[i] == want(u), (u or "")[:80]


def test_url_rules_without_broadcast(spark, monkeypatch):
    whole = sorted(map(str, judge_urls(pages(spark), rule_table(spark)).collect()))
    monkeypatch.setattr("keystrata.llm.url_filter.BROADCAST_RULES", 0)
    assert sorted(map(str, judge_urls(pages(spark), rule_table(spark)).collect())) == whole


def test_line_dedup(spark):
    html = lambda i: f"<nav>Menu</nav><p>text {i}</p><p>text {i}</p><script>if (a<b) x('</p>')</script>"
    rows = [(i, "http://s.com/" + str(i), html(i)) for i in range(10)] + [(10, "http://t.com/", html(1)), (11, None, None)]
    got = {r.id: (r.n_lines, r.n_dropped, r.kept_text) for r in site_line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == (3, 1, "text 3\ntext 3") and got[10] == (3, 0, "Menu\ntext 1\ntext 1") and got[11] == (0, 0, "")
    assert site_line_dedup(pages(spark)).count() == 8 and site_line_dedup(pages(spark).limit(0)).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    docs, rows = odd_docs(spark)
    more = spark.createDataFrame([(100 + i, f"group {i % 40}" if i < 400 else "hot" if i < 900 else f"single {i}", "s") for i in range(1500)], "doc_id long, text string, source string")
    got = shard_documents(docs.select("doc_id", "text", "source").union(more)).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == 1517 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    texts = dict((r[0], r[1]) for r in rows) | {100 + i: f"group {i % 40}" for i in range(400)}
    assert all(r.text_crc32 == zlib.crc32((texts[r.id] or "").encode()) and r.size == len((texts[r.id] or "").encode()) + 1 for r in got if r.id in texts and r.id not in (3, None))
    homes = collections.defaultdict(set)
    for r in got:
        if r.id is not None and 100 <= r.id < 500:
            homes[r.id % 40].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())  # every group that fits a shard is whole, also beside the hot one
    assert shard_documents(empty(spark)).count() == 0
    assert max(collections.Counter(r.shard for r in shard_documents(docs).collect()).values()) == 2


def test_shards_of_the_documents_cut_few_links(spark):
    """Against brute force on the whole table: laws, sizes, digests, and the fewest links cut that capacity allows."""
    from keystrata.llm.sharding import cut_edges

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = entry.queries()["op6_shard_documents"](spark, SF)
    got = {r.doc_id: r for r in placed.collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None)
        groups[t].append(got[i])
    most = -(-len(texts) // 16)
    cut = sum(len({r.shard for r in g}) - 1 for g in groups.values())
    assert cut == sum(-(-len(g) // most) - 1 for g in groups.values()) and all(r.group_rows == len(g) for g in groups.values() for r in g)
    told = cut_edges(placed.join(docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("group")), "doc_id")).first()
    assert (told.edges, told.cut) == (len(texts) - len(groups), cut)


def test_mixing(spark):
    docs, rows = odd_docs(spark)
    got = mix(docs).collect()
    assert len(got) == len(rows) and mix(empty(spark)).count() == 0
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in over} if over else share
        open_ -= over or set(open_)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
    again = sorted((str(r) for r in mix(docs.repartition(5)).collect()))
    assert again == sorted(str(r) for r in got)
    many = spark.createDataFrame([(i, "w " * (1 + i * 7 % 90), "big" if i % 3 else f"s{i % 4}") for i in range(3000)], "doc_id long, text string, source string")
    mixed = mix(many)
    for r in mixed.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("got")).collect():
        assert abs(r.t - r.got) <= 3
    placed = curriculum(mixed)
    assert placed.where("position < 0 or position > 1").count() == 0 and placed.count() == mixed.agg(F.sum("copies")).first()[0]


def test_a_long_document_does_not_end_the_mix(spark):
    """What is missing is at most half of the smallest document that could still be taken."""
    rows = [(i, "w " * (90 + i % 21), "a") for i in range(200)] + [(900, "w " * 20_000, "a")] + [(1000 + i, "w " * 1000, "b") for i in range(40)]
    for shift in range(3):  # wherever the long one stands in the order
        got = mix(spark.createDataFrame([(i + shift * 10_000, t, s) for i, t, s in rows], "doc_id long, text string, source string")).collect()
        for source in "ab":
            own = [r for r in got if r.source == source]
            least = min(r.copies for r in own)
            left = [r.size for r in own if r.copies == least]
            assert abs(own[0].target - sum(r.taken for r in own)) <= min(left) / 2


def test_line_dedup_against_brute_force(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [(10**6 + i, "http://one.org/x", f"<p>top</p><p>line {i % 3}</p>") for i in range(7)] + [(1, None, "<p>top</p>"), (1, "", None)]
    lines, hosts = [], []
    for _, url, html in rows:
        t = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "\n", html or "")
        t = re.sub(r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|nav|article|section|header|footer|title|body|head|html)\b[^>]*>", "\n", t)
        lines.append([x for x in (y.strip(" \t\r\x0b\x0c") for y in re.sub(r"<[^>]*>", "", t).split("\n")) if x])
        hosts.append(re.match(r"[^/?#]*", url.split("://", 1)[1])[0].translate(LOWER) if url and "://" in url else "")
    total, pages_ = collections.Counter(hosts), collections.Counter((h, x) for h, ls in zip(hosts, lines, strict=True) for x in set(ls))
    kept = [[x for x in ls if not (pages_[h, x] >= 3 and pages_[h, x] > 0.3 * total[h])] for h, ls in zip(hosts, lines, strict=True)]
    want = collections.Counter((r[0], h, len(ls), len(ls) - len(k), "\n".join(k)) for r, h, ls, k in zip(rows, hosts, lines, kept, strict=True))
    got = site_line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert collections.Counter((r.id, r.host, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want and sum(x[3] for x in want) > 5


def test_mixing_query_places_every_copy(spark):
    got = entry.queries()["op10_mix_sources"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mix(docs)
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in got) == collections.Counter((r.id, r.size, r.taken) for r in mixed.collect())
    at = sorted(p for r in got for p in (r.position, r.position_2, r.position_3) if p is not None)
    assert at == sorted(r.position for r in curriculum(mixed).collect())
    first = [r.position for r in got if r.position is not None]
    assert first == sorted(first) and [r.position for r in got[len(first) :]] == [None] * (len(got) - len(first))
    assert placements(empty(spark)).count() == 0


def test_tokens_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, rows = odd_docs(spark)
    path = str(tmp_path / "shards")
    tokens.write_token_shards(docs, path, default_tokenizer())
    plain = Tokenizer.from_file(default_tokenizer())
    got = tokens.read_token_shards(spark, path, ids=True).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == len(rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    want = collections.Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    import numpy as np

    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert sorted(map(tuple, tokens.read_document(path, 3))) == sorted(x for (i, x), n in want.items() if i == 3)
    tokens.write_token_shards(empty(spark), str(tmp_path / "none"), default_tokenizer())
    assert tokens.read_token_shards(spark, str(tmp_path / "none")).count() == 0


def test_token_shards_are_read_without_processes_beside_the_driver(spark, tmp_path):
    docs, rows = odd_docs(spark)
    path = str(tmp_path / "shards")
    tokens.write_token_shards(docs.repartition(3), path, default_tokenizer())
    got = tokens.read_token_shards(spark, path, ids=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and "MapInArrow" in plan  # a Python source is planned in six processes of the driver
    assert got.rdd.getNumPartitions() == len(tokens._manifest(path)["shards"])
    spark.dataSource.register(tokens.TokenSource)
    source = spark.read.format("token_shards").option("ids", "true").load(path)
    assert source.schema == got.schema
    assert sorted(map(repr, source.collect())) == sorted(map(repr, got.collect())) and source.count() == len(rows)
    assert tokens.read_token_shards(spark, path).columns == source.columns[:-1]
    tokens.write_token_shards(empty(spark), str(tmp_path / "none"), default_tokenizer())
    assert spark.read.format("token_shards").load(str(tmp_path / "none")).count() == 0


def test_encoder_of_another_kind_gives_the_librarys_ids():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, other = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["Hello  World again", "ÀB c\nd <|endoftext|> e", "", "one two one"]
    assert not other.cuts
    for t, raw in zip(texts, other.encode(texts), strict=True):
        assert np.frombuffer(raw, other.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_encoder_forgets_long_words():
    fast = tokens.Encoder(default_tokenizer())
    fast.encode(["x" * 5000 + " " + "y" * 49 + " short"])
    assert fast.cuts and max(map(len, fast.young)) <= tokens.MEMO_CHARS and " short".strip() in fast.young


def test_encoder_cuts_nothing_apart():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(default_tokenizer()), tokens.Encoder(default_tokenizer())
    import numpy as np

    texts = ["", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n", "a\n", "a\n\nb", "  x  ", "é ñ  x", "don't  stop", "a\tb c\r\n d", "a  b", "a  b", "x\0y z", "a \1b", "\1a b", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endof text|>", "w" * 100 + " " + "v" * 60 + "\n" + "u" * 70 + " é" * 40, "a\x1c b c", "Hello, world.\nNext line!! 12 3"] * 2
    for t, raw in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(raw, fast.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_boilerplate_look_ahead_spares_no_phrase():
    """The expression with the look at two letters finds what the plain one finds, in any case and place."""
    phrases = ["cookie policy", "use cookies", "uses cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "subscribe to our", "click here", "powered by", "skip to content", "lorem ipsum"]
    for phrase in phrases:
        for text in (phrase, phrase.upper(), f"xx{phrase.title()}yy"):
            assert re.search(quality.BOILERPLATE, text) and re.search(quality.FAST_BOILERPLATE, text)
    for text in ("", "cookies", "user of cookie", "terms of trade", "ﬁne lines"):
        assert not re.search(quality.BOILERPLATE, text) and not re.search(quality.FAST_BOILERPLATE, text)


def test_encoder_learns_all_new_words_of_a_batch_in_one_call():
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self):
            self.model, self.calls = Tokenizer.from_file(default_tokenizer()), []

        def __getattr__(self, name):
            self.calls.append(name)
            return getattr(self.model, name)

    import numpy as np

    fast, plain = tokens.Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    fast.model = Counted()
    texts = [f"first{i} second, {i}\nthird" for i in range(500)] + [" begins with a space"]
    for _ in range(2):  # the second time all words are known
        assert [np.frombuffer(x, fast.dtype).tolist() for x in fast.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert fast.model.calls == ["encode_batch_fast"]


def test_encoder_equals_the_library_over_generations(monkeypatch):
    import random

    import numpy as np
    from tokenizers import Tokenizer

    plain, r = Tokenizer.from_file(default_tokenizer()), random.Random(4)
    parts = ["word", "x,", "don't", "é", "日本語", "。", "’", "😀", "²", "w" * 22, "w" * 23, "w" * 24, "é" * 12, "v" * 60, "\0", "\1", "<|endoftext|>"] + list("\t\r\x1c\x85\xa0\u1680\u180e\u2003\u2028\u202f\u205f\u3000\u200b\ufeff")
    weights = [8] * 14 + [0.1] * 17
    for memo, long in ((tokens.MEMO, tokens.MEMO_LONG), (40, 3)):
        monkeypatch.setattr(tokens, "MEMO", memo)
        monkeypatch.setattr(tokens, "MEMO_LONG", long)
        fast = tokens.Encoder(default_tokenizer())
        for n in range(400):
            texts = ["".join(r.choices([*parts, " ", "\n", str(n)], [*weights, 60, 15, 8], k=r.randint(0, 40))) for _ in range(r.randint(0, 6))]
            for t, raw in zip(texts, fast.encode([*texts, None]), strict=False):
                assert np.frombuffer(raw, fast.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
        assert fast.table.count > 20 and (fast.old.count > memo) == (memo == 40)


def test_word_table_grows_and_tells_all_rows_apart():
    import numpy as np

    r = np.random.default_rng(5)
    rows = np.unique(r.integers(0, 80, (120_000, 3)).astype(np.uint64) << np.uint64(56) | np.uint64(32), axis=0)  # differ in the top byte only
    have, lack = rows[::2], rows[1::2]
    table, at = tokens._Words(np.dtype("<u2")), 0
    while at < len(have):
        part, length = have[at : at + 9000], (np.arange(at, at + len(have[at : at + 9000])) % 4).astype(np.int32)
        table.add(list(part.T.copy()), np.repeat(np.arange(len(part), dtype="<u2"), length), length)
        at += len(part)
    number = table.find(list(have.T.copy()))
    assert table.count == len(have) + 1 and sorted(number) == list(range(1, table.count)) and (table.find(list(lack.T.copy())) == -1).all()
    assert (table.length[number] == np.arange(len(have)) % 4).all() and 2 * table.count <= table.slot_word.size
    want = np.repeat(np.arange(len(have)) % 9000, np.arange(len(have)) % 4)
    assert (tokens._spans(table.ids, table.start[number], table.length[number].astype(np.int64)) == want).all()


def test_idle_worker_gives_its_encoder_back(monkeypatch):
    import time
    import weakref

    monkeypatch.setattr(tokens, "IDLE_SECONDS", 0.3)
    with tokens.borrowed_encoder(default_tokenizer()) as encoder:
        encoder.encode(["some words"])
    with tokens.borrowed_encoder(default_tokenizer()) as again:
        assert again is encoder  # the next task has the same words
        time.sleep(0.6)
        assert tokens.encoder_for(default_tokenizer()) is encoder  # the first task's end does not take them from the second
    gone = weakref.ref(encoder)
    del encoder, again
    for _ in range(100):
        if gone() is None:
            break
        time.sleep(0.1)
    assert gone() is None and tokens.encoder_for.cache_info().currsize == 0
