import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from keystrata.functions import bloom, codec
from keystrata.operators import protocol, recovery, runs, store, visibility
from keystrata.operators.store import Keyspace
from keystrata.plans.latest import STRATEGIES
from keystrata.sources import files

LOG = "seq long, key string, op byte, value string"


def make_log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def state(rows):
    out = {}
    for _, k, op, v in sorted(rows, key=lambda r: r[0]):
        out[k] = (op, v)
    return {k: v for k, (op, v) in out.items() if op == 1}


def random_rows(n, keys, seed):
    r = random.Random(seed)
    return [(i, f"k{r.randrange(keys)}", op := r.choice([1, 1, 2]), f"v{i}" if op == 1 else "") for i in range(n)]


@pytest.mark.parametrize("strategy", sorted(STRATEGIES))
def test_live_is_the_last_write(spark, strategy):
    rows = random_rows(400, 40, 1) + [(1000, "", 1, ""), (1001, "gone", 1, "x"), (1002, "gone", 2, "")]
    got = {r.key: r.value for r in visibility.live(make_log(spark, rows), strategy).collect()}
    assert got == state(rows)


def test_empty_log(spark):
    log = make_log(spark, [])
    assert visibility.live(log).count() == 0
    assert visibility.scan_flat(log, "a").count() == 0
    assert [r.found for r in visibility.seek(log, spark.createDataFrame([("a",)], "probe string")).collect()] == [None]


def test_seek_and_next_follow_byte_order(spark):
    rows = [(i, k, 1, "v") for i, k in enumerate(["10", "2", "9", "B", "a", "é"])]
    log = make_log(spark, rows)
    probes = spark.createDataFrame([("",), ("1",), ("10",), ("3",), ("a",), ("b",), ("zz",), ("\U0001f600",)], "probe string")
    assert {r.probe: r.found for r in visibility.seek(log, probes).collect()} == {"": "10", "1": "10", "10": "10", "3": "9", "a": "a", "b": "é", "zz": "é", "\U0001f600": None}
    assert {r.key: r.next_key for r in visibility.next_keys(log).collect()} == {"10": "2", "2": "9", "9": "B", "B": "a", "a": "é", "é": None}


def test_positions_lose_no_row(spark):
    """Wide rows, many partitions: bounds and merged partitions must not differ between two uses of one order."""
    import bisect

    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = 400_000
        wide = spark.range(n).select((F.col("id") % 37).alias("wal_id"), F.col("id").alias("ordinal"), F.md5(F.col("id").cast("string")).alias("key"), F.lit(1).cast("byte").alias("op"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("value"))
        assert tuple(recovery.replay(wide).agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()) == (n, n, 0, n - 1)
        log = wide.select(F.col("ordinal").alias("seq"), "key", "op", "value")
        assert tuple(visibility.scan_flat(log, "").agg(F.count("*"), F.count_distinct("pos"), F.max("pos")).first()) == (2 * n, 2 * n, 2 * n - 1)
        keys = log.where("seq % 8 = 0")
        order = sorted(r.key for r in keys.select("key").collect())
        found = visibility.seek(keys, log.where("seq % 4 = 0").select(F.col("key").alias("probe"))).collect()
        assert len(found) == n // 4
        for r in found:
            k = bisect.bisect_left(order, r.probe)
            assert r.found == (order[k] if k < len(order) else None)
        assert {r.key: r.next_key for r in visibility.next_keys(keys).collect()} == dict(zip(order, [*order[1:], None], strict=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_put_continues_the_sequence(spark):
    log = make_log(spark, [(7, "a", 1, "x")])
    more = spark.createDataFrame([(2, "a", 2, ""), (1, "b", 1, "y")], "order long, key string, op byte, value string")
    assert sorted((r.seq, r.key) for r in visibility.put(log, more).collect()) == [(7, "a"), (8, "b"), (9, "a")]


@pytest.mark.parametrize("seed", range(3))
def test_compaction_keeps_the_visible_state(spark, seed):
    rows = random_rows(300, 25, seed)
    log = make_log(spark, rows).withColumn("run", F.floor(F.col("seq") / 50).cast("int"))
    flushed = runs.flush(log)
    upper, lower = flushed.where("run >= 3"), flushed.where("run < 3")
    merged = runs.compact(upper, lower).withColumn("run", F.lit(9)).unionByName(lower.select("key", "op", "value", "run"))
    assert {r.key: r.value for r in runs.full_compaction(merged).collect()} == state(rows)
    kept = {r.key for r in runs.compact(upper, lower).where("op = 2").collect()}
    dropped = {r.key for r in runs.dropped_tombstones(upper, lower).collect()}
    assert not kept & dropped


def test_rotation_counts_distinct_keys(spark):
    rows = [(0, "a", 1, ""), (1, "a", 1, ""), (2, "b", 2, ""), (3, "a", 1, ""), (4, "c", 1, ""), (5, "c", 1, "")]
    assert [r.epoch for r in runs.rotation_epochs(make_log(spark, rows), 2).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 2]


def test_blocks_are_cut_greedily(spark):
    rows = spark.createDataFrame([(1, f"k{i:03d}", "x" * 100) for i in range(100)], "run int, key string, value string")
    got = [r.block for r in runs.assign_blocks(rows).orderBy("key").collect()]
    used = block = 0
    want = []
    for _ in range(100):
        if used >= 4096:
            block, used = block + 1, 0
        want.append(block)
        used += 113
    assert got == want
    sizes = spark.createDataFrame([("key1", "value1"), ("", ""), ("é", "ü")], "k string, v string").select(runs.entry_bytes(F.col("k"), F.col("v")).alias("n"))
    assert [r.n for r in sizes.collect()] == [19, 9, 13]


def bloom_reference(key: bytes) -> int:
    h = 0xBC9F1D34 ^ len(key)
    for b in key:
        h ^= b if b < 128 else b | 0xFFFFFF00
        h = h * 0x5BD1E995 % 2**32
        h ^= h >> 15
    return h


def test_bloom_hash_and_no_false_negatives(spark):
    keys = ["", "a", "key_1", "13", "é", "\x7f\x80", "\U0001f600" * 3]
    got = {r.key: r.h for r in spark.createDataFrame([(k,) for k in keys], "key string").select("key", bloom.bloom_hash(F.col("key")).alias("h")).collect()}
    assert got == {k: bloom_reference(k.encode()) for k in keys}
    held = spark.createDataFrame([(r, f"k{i}") for r in (1, 2) for i in range(200)], "run int, key string")
    filters = bloom.create_filters(held)
    assert bloom.may_match(filters, held).where("not maybe").count() == 0
    strangers = spark.createDataFrame([(1, f"z{i}") for i in range(1000)], "run int, key string")
    assert bloom.may_match(filters, strangers).where("maybe").count() < 60


def test_replies(spark):
    log = spark.createDataFrame([], LOG)
    words = [["SET", "alpha", "1"], ["SET", "beta", "2"], ["gEt", "alpha"], ["RSCAN", "alpha"], ["DEL", "alpha"], ["GET", "alpha"], ["RSCAN", "alpha"], ["PING"], ["GET"], [], ["SET", "é", ""], ["GET", "é"], ["RSCAN", "zz~"], ["DEL", "none"]]
    commands = spark.createDataFrame([(1, 1, i, w) for i, w in enumerate(words)], "conn_id long, generation long, req_seq long, argv array<string>")
    after, replies = protocol.execute(log, commands)
    got = [r.reply for r in replies.orderBy("req_seq").collect()]
    ok = "+OK\r\n"
    assert got == [
        ok, ok, "$1\r\n1\r\n", "*4\r\n$5\r\nalpha\r\n$1\r\n1\r\n$4\r\nbeta\r\n$1\r\n2\r\n", ok, "$-1\r\n", "*2\r\n$4\r\nbeta\r\n$1\r\n2\r\n",
        "-ERR unknown command 'PING'\r\n", "-ERR wrong number of arguments for 'GET' command\r\n", "-ERR empty command\r\n", ok, "$0\r\n\r\n", "*2\r\n$2\r\né\r\n$0\r\n\r\n", ok,
    ]
    assert {r.key: r.value for r in visibility.live(after).collect()} == {"beta": "2", "é": ""}


def test_parser_takes_pieces():
    p = codec.RequestParser()
    frame = b"*3\r\n$3\r\nSET\r\n$3\r\nkey\r\n$5\r\nvalue\r\n"
    for cut in range(1, len(frame)):
        q = codec.RequestParser()
        assert q.feed(frame[:cut]) == [] and q.feed(frame[cut:]) == [[b"SET", b"key", b"value"]]
    assert p.feed(b"\r\n*1\r\n$4\r\nPING\r\n*0\r\n*1\r\n$-1\r\n*1\r\n$3\r\na\0b\r\n") == [[b"PING"], [], [b""], [b"a\0b"]]
    for bad in (b"+NOTARRAY\r\n", b"*-1\r\n", b"*2x\r\n", b"*1\r\n$-2\r\n", b"*1\r\n$3x\r\n", b"*1\r\n$1\r\nabc\r\n"):
        with pytest.raises(codec.ProtocolError):
            codec.RequestParser().feed(bad)


def test_requests_in_pieces(spark):
    frame = b"*2\r\n$3\r\nGET\r\n$4\r\n\xc3\xa9\xff!\r\n"
    rows = [(1, i, bytearray(frame[i : i + 1])) for i in range(len(frame))] + [(1, 900, None), (2, 5, bytearray(b"*1\r\n$4\r\nPING\r\n*-1\r\n")), (2, 6, bytearray(frame)), (3, 1, bytearray(b"*1\r\n"))]
    got = protocol.parse_requests(spark.createDataFrame(rows, "conn_id long, piece long, data binary")).collect()
    assert sorted((r.conn_id, r.req_seq, r.argv, r.error) for r in got) == [(1, 0, ["GET", "é\ufffd!"], None), (2, 0, ["PING"], None), (2, 1, None, "-ERR protocol error\r\n")]


def test_recovery_rules(spark):
    names = spark.createDataFrame([(x,) for x in ("3.sst", "9.sst", "12.wal", "4.wal", "a7.sst", "7.sst.tmp", ".wal", "3.sst")], "name string")
    on_disk = recovery.numbered_files(names)
    assert {tuple(r) for r in on_disk.collect()} == {("run", 3), ("run", 9), ("wal", 12), ("wal", 4)} and recovery.next_number_from_files(on_disk).first()[0] == 12
    state_ = spark.createDataFrame([("run", 3, 1), ("run", 8, 0), ("run", 9, 5), ("wal", 4, None), ("wal", 6, None)], "kind string, id long, level long")
    assert [tuple(r) for r in recovery.runs_to_open(state_, on_disk).collect()] == [(3, 1)]
    assert sorted(map(tuple, recovery.runs_to_open(state_.where("kind = 'wal'"), on_disk).collect())) == [(3, 0), (9, 0)]
    assert recovery.runs_to_open(state_.where("id = 8"), on_disk).count() == 0  # named but missing: no fallback
    assert {tuple(r) for r in recovery.logs_to_replay(state_, on_disk).collect()} == {(4, True), (12, True), (6, False)}
    proposed = spark.createDataFrame([(4, 4, None), (4, 5, None), (5, 6, None), (5, 7, None), (2, 3, 1), (3, 99, None)], "op int, id long, level long")
    assert sorted((r.op, r.id) for r in recovery.edits_to_log(state_, proposed).collect()) == [(2, 3), (3, 99), (4, 5), (5, 6)]
    assert recovery.next_number_from_files(recovery.numbered_files(names.limit(0))).first()[0] == 0


def test_metadata_fold(spark):
    edits = spark.createDataFrame([(0, 2, 5, 0), (1, 2, 6, 0), (2, 3, 5, None), (3, 4, 7, None), (4, 4, 8, None), (5, 5, 7, None), (6, 1, 12, None), (7, 2, 9, 4)], "edit_seq long, op byte, id long, level long")
    state_ = recovery.valid_levels(recovery.fold_edits(edits))
    assert {(r.kind, r.id, r.level) for r in state_.collect()} == {("run", 6, 0), ("wal", 8, None)}
    assert recovery.next_file_number(edits).first()[0] == 12
    with pytest.raises(Exception, match="unknown metadata edit"):
        recovery.fold_edits(edits.withColumn("op", F.when(F.col("edit_seq") == 3, 9).otherwise(F.col("op")))).collect()


def test_native_logs(spark, tmp_path):
    good = [(1, b"city", b"Lyon"), (1, b"fruit", b"plum"), (2, b"", b"")]
    (tmp_path / "2.wal").write_bytes(b"".join(files.encode_log_record(*r) for r in good))
    ten = b"".join(files.encode_log_record(*r) for r in [(1, b"city", b"Graz"), (2, b"fruit", b"")])
    bad = bytearray(files.encode_log_record(1, b"late", b"x"))
    bad[-1] ^= 1
    (tmp_path / "10.wal").write_bytes(ten + bytes(bad) + files.encode_log_record(1, b"after", b"y"))
    (tmp_path / "x.wal").write_bytes(b"junk")
    (tmp_path / "3.wal").write_bytes(b"\1\2\3")
    rows = files.read_native(spark, "mutation_wal", str(tmp_path))
    assert rows.count() == 5
    live = visibility.live(recovery.replay(rows)).collect()
    assert {bytes(r.key): bytes(r.value) for r in live} == {b"city": b"Graz"}
    torn = files.encode_log_record(1, b"k", b"v")
    for cut in range(len(torn)):
        assert list(files.decode_log(torn[:cut])) == []
    huge = struct.pack("<BI", 1, 0xFFFFFFF0)
    assert list(files.decode_log(struct.pack("<I", zlib.crc32(huge)) + huge + b"abc" * 9)) == []


def test_native_runs_and_metadata(spark, tmp_path):
    records = [(f"row/{i:05d}".encode(), 2 if i % 7 == 0 else 1, b"" if i % 7 == 0 else b"v" * (i % 50)) for i in range(2000)]
    data = files.encode_run(records, bloom.pack(64, [1, 9]))
    (tmp_path / "4.sst").write_bytes(data)
    got = files.read_native(spark, "sorted_run", str(tmp_path)).orderBy("key").collect()
    assert [(bytes(r.key), r.op, bytes(r.value)) for r in got] == records
    index = files.read_native(spark, "sorted_run", str(tmp_path), index="true").orderBy("block").collect()
    assert bytes(index[-1].last_key) == records[-1][0] and sum(r.bytes for r in index) == files.decode_footer(data)[2]
    with pytest.raises(ValueError):
        files.decode_footer(data[:-1])
    edits = files.encode_edit(1, 7) + files.encode_edit(2, 5, 1) + files.encode_edit(4, 6)
    (tmp_path / "log").write_bytes(edits + files.encode_edit(3, 5)[:-3])
    assert [tuple(r) for r in files.read_native(spark, "metadata_edits", str(tmp_path / "log")).collect()] == [(0, 1, 7, None), (1, 2, 5, 1), (2, 4, 6, None)]
    with pytest.raises(ValueError):
        list(files.decode_edits(b"\0" + edits))
    assert files.decode_snapshot(files.encode_snapshot(9, {5: 1, 3: 0}, [8])) == (9, {3: 0, 5: 1}, [8])


def test_native_files_round_trip(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    rows = [(run, f"{run}/{i:05d}".encode(), 2 if i % 9 == 0 else 1, b"" if i % 9 == 0 else bytes([i % 256]) * (i % 60)) for run in (3, 12) for i in range(3000)]
    table = spark.createDataFrame([(r, bytearray(k), o, bytearray(v)) for r, k, o, v in rows], "run long, key binary, op int, value binary")
    files.write_native_runs(table.repartition(5), path)
    back = files.read_native(spark, "sorted_run", path, range_bytes="20000")
    assert sorted((r.run, bytes(r.key), r.op, bytes(r.value)) for r in back.collect()) == rows and back.rdd.getNumPartitions() > 2
    assert [(r.run, bytes(r.value)) for r in back.where(F.col("key") == F.lit(b"3/00010")).collect()] == [(3, bytes([10]) * 10)]
    some = back.where(F.col("key").isin([b"3/00009", b"12/02999", b"none", b""])).collect()
    assert sorted((bytes(r.key), r.op) for r in some) == [(b"12/02999", 1), (b"3/00009", 2)]
    span = back.where((F.col("key") >= F.lit(b"12/01000")) & (F.col("key") < F.lit(b"12/01005")))
    assert sorted(bytes(r.key) for r in span.collect()) == [f"12/{i:05d}".encode() for i in range(1000, 1005)]
    packed = {r.run: bytes(r.data) for r in files.read_native(spark, "sorted_run", path, filter="true").collect()}
    text = spark.createDataFrame([(r, k.decode()) for r, k, _, _ in rows], "run int, key string")
    assert packed == {r.run: bytes(r.data) for r in bloom.packed_filters(bloom.create_filters(text)).collect()}
    assert all(bloom.may_hold(packed[r], k) for r, k, _, _ in rows) and not bloom.may_hold(b"\6", b"x") and sum(bloom.may_hold(packed[3], b"z%d" % i) for i in range(1000)) < 60
    read, whole = [], files.RunFile(files.open_fs(path)[0].open_input_file(f"{path}/3.sst"))
    monkeypatch.setattr(files.RunFile, "block", lambda self, k, f=files.RunFile.block: read.append(k) or f(self, k))
    assert [r[0] for r in whole.find({b"3/01500"})] == [b"3/01500"] and len(read) == 1
    assert list(whole.find({b"zzz", b"0"})) == [] and len(read) <= 2
    with pytest.raises(Exception, match="files that exist"):
        files.write_native_runs(table, path)
    logs = spark.createDataFrame([(w, i, 1, bytearray(b"k%d" % i), bytearray(b"v" * 70_000 * (i % 30 == 0))) for w in (2, 10) for i in range(60)], "wal_id long, ordinal long, op int, key binary, value binary")
    files.write_native_logs(logs.repartition(3), path)
    got = files.read_native(spark, "mutation_wal", path).orderBy("wal_id", "ordinal").collect()
    assert got == logs.orderBy("wal_id", "ordinal").collect()


def test_metadata_is_checkpointed(tmp_path):
    m = files.Metadata(str(tmp_path))
    assert m.edit(1, 5) and m.edit(4, 7) and not m.edit(4, 7) and not m.edit(5, 8) and m.edit(2, 9, 1) and m.edit(2, 10, 0) and m.edit(3, 10)
    again = files.Metadata(str(tmp_path))
    assert (again.next, again.runs, again.wals, again.logged) == (5, {9: 1}, {7}, 5)
    for i in range(94):
        again.edit(4, 100 + i)
    assert (tmp_path / "MANIFEST.log").stat().st_size > 0
    again.edit(5, 7)
    assert (tmp_path / "MANIFEST.log").stat().st_size == 0 and again.logged == 0
    last = files.Metadata(str(tmp_path))
    assert (last.next, last.runs, len(last.wals)) == (5, {9: 1}, 94)
    (tmp_path / "MANIFEST").write_bytes(b"short")
    with pytest.raises(ValueError):
        files.Metadata(str(tmp_path))


def test_keyspace(spark, tmp_path):
    k = Keyspace(spark, str(tmp_path / "db"))
    schema = "order long, key string, op byte, value string"
    k.write(spark.createDataFrame([(1, "a", 1, "old"), (2, "b", 1, "x"), (3, "a", 1, "new")], schema))
    assert k.get("a") == "new" and k.get("zz") is None and k.status()["mem_count"] == 2
    k.flush()
    k.write(spark.createDataFrame([(1, "b", 2, ""), (2, "ghost", 2, "")], schema))
    k.flush()  # the second level-0 run starts a compaction
    assert (k.level_size(0), k.level_size(1), k.level_size(7)) == (0, 1, 0)
    assert {r.key: r.value for r in k.live().collect()} == {"a": "new"}
    again = Keyspace(spark, str(tmp_path / "db"))
    assert again.get("b") is None and again.status()["flushes"] == 2
    again.write(spark.createDataFrame([(1, "nobody", 2, "")], schema))
    again.flush()
    again.compact()
    assert again.level_size(0) == 0 and again.get("a") == "new"
    assert again.vacuum() and again.get("a") == "new" and again.vacuum() == []
    version, held = again._version()
    again.write(spark.createDataFrame([(1, "c", 1, "z")], schema), ("stream", 0))
    again.write(spark.createDataFrame([(1, "c", 1, "again")], schema), ("stream", 0))
    assert again.get("c") == "z" and again.status()["mem_count"] == 1
    with pytest.raises(store.Conflict):
        again._commit(version, held)
    again.close()
    assert again.status()["mem_count"] == 0 and again.status()["flush_ms"] > 0


def test_stream_equals_batch(spark, tmp_path):
    from keystrata.streaming.live_view import flush_stream, streaming_live

    rows = random_rows(200, 15, 9)
    source = str(tmp_path / "in")
    make_log(spark, rows).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    query = streaming_live(stream).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.key: r.value for r in spark.table("seen").collect()} == state(rows)
    k = Keyspace(spark, str(tmp_path / "db"))
    whole = spark.readStream.schema(LOG).parquet(source)
    flush_stream(whole, k, str(tmp_path / "check")).awaitTermination(120)
    assert {r.key: r.value for r in k.live().collect()} == state(rows)
