"""Readers and writers of the engine's native files as PySpark data sources.

All integers are little-endian. Log record: crc32 of the payload, then the payload: type byte, key length, key, value
length, value. Run file: data blocks, filter block, index block, 40-byte footer. Metadata: a snapshot and an edit log.
Logs stream, and a damaged or torn tail ends a log's records without failing. Runs are read block by block: predicates on the key
pass the filter, then the index, and only blocks that can hold a match are read; large runs are cut into ranges of blocks.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import bloom
from ..model import ADD_RUN, ADD_WAL, BLOCK_BYTES, CHECKPOINT_EDITS, DROP_RUN, DROP_WAL

#: Bytes that a log's reader takes at a time, and data bytes of a run that one task reads.
CHUNK, RANGE_BYTES = 1 << 20, 64 << 20
RUN_MAGIC = 0xDEADC0DEFA112026
META_MAGIC, META_VERSION = 0x12345678, 1


def open_fs(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def encode_log_record(op: int, key: bytes, value: bytes) -> bytes:
    payload = struct.pack("<BI", op, len(key)) + key + struct.pack("<I", len(value)) + value
    return struct.pack("<I", zlib.crc32(payload)) + payload


def decode_log(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Records up to the first that is torn or fails its checksum."""
    yield from stream_log(iter([data]), len(data))


def stream_log(chunks: Iterator[bytes], size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Records of a log of ``size`` bytes that comes in pieces; lengths are checked before anything is read for them."""
    held, at = b"", 0  # ``at``: place in the log of the first byte held

    def have(n: int) -> bool:
        nonlocal held
        if at + n > size:
            return False
        parts, got = [held], len(held)
        while got < n:
            more = next(chunks, b"")
            if not more:
                return False
            parts.append(more)
            got += len(more)
        held = b"".join(parts) if len(parts) > 1 else held
        return True

    while have(9):
        crc, op, klen = struct.unpack_from("<IBI", held)
        if not have(13 + klen):
            return
        (vlen,) = struct.unpack_from("<I", held, 9 + klen)
        end = 13 + klen + vlen
        if not have(end) or zlib.crc32(memoryview(held)[4:end]) != crc:
            return
        yield op, held[9 : 9 + klen], held[13 + klen : end]
        held, at = held[end:], at + end


def _entry(key: bytes, op: int, value: bytes) -> bytes:
    return struct.pack("<I", len(key)) + key + struct.pack("<BI", op, len(value)) + value


def _entries(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        (klen,) = struct.unpack_from("<I", data, at)
        head = at + 4 + klen
        if head + 5 > len(data):
            return  # a torn tail
        op, vlen = struct.unpack_from("<BI", data, head)
        if head + 5 + vlen > len(data):
            return
        yield data[at + 4 : head], op, data[head + 5 : head + 5 + vlen]
        at = head + 5 + vlen


class RunBuilder:
    """Writes a run file as records come in key order; a block closes once it has reached its size. Keeps keys' hashes and the index only."""

    def __init__(self, write: Callable[[bytes], object]):
        self.write, self.at, self.index, self.block, self.last, self.hashes = write, 0, bytearray(), bytearray(), b"", []

    def _close(self) -> None:
        self.index += _entry(self.last, 1, struct.pack("<QQ", self.at, len(self.block)))
        self.write(bytes(self.block))
        self.at += len(self.block)
        self.block.clear()

    def add(self, key: bytes, op: int, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._close()
        self.block += _entry(key, op, value)
        self.last = key
        self.hashes.append(bloom.hash_bytes(key))

    def finish(self, filter_data: bytes | None = None) -> None:
        """Filter (that of the keys unless given), index and footer."""
        if self.block:
            self._close()
        data = bloom.pack_hashes(self.hashes) if filter_data is None else filter_data
        self.write(data + bytes(self.index) + struct.pack("<QQQQQ", self.at + len(data), len(self.index), self.at, len(data), RUN_MAGIC))


def encode_run(records: list[tuple[bytes, int, bytes]], filter_data: bytes | None = None) -> bytes:
    """A run file from (key, op, value) in key order."""
    out: list[bytes] = []
    builder = RunBuilder(out.append)
    for r in records:
        builder.add(*r)
    builder.finish(filter_data)
    return b"".join(out)


def decode_footer(data: bytes) -> tuple[int, int, int, int]:
    """(index offset, index size, filter offset, filter size); fails on a short file or a wrong magic."""
    if len(data) < 40 or struct.unpack_from("<Q", data, len(data) - 8)[0] != RUN_MAGIC:
        raise ValueError("not a run file")
    return struct.unpack_from("<QQQQ", data, len(data) - 40)


def decode_index(data: bytes) -> list[tuple[bytes, int, int]]:
    at, size, _, _ = decode_footer(data)
    return _index(data[at : at + size], len(data))


def _index(data: bytes, size: int) -> list[tuple[bytes, int, int]]:
    rows = [(k, *struct.unpack("<QQ", v)) for k, _, v in _entries(data) if len(v) == 16]
    if not rows or any(o + n > size for _, o, n in rows):
        raise ValueError("a run needs an index within the file")
    return rows


def encode_edit(op: int, number: int, level: int | None = None) -> bytes:
    payload = struct.pack("<Q", number) + (struct.pack("<I", level) if level is not None else b"")
    return struct.pack("<IIBI", META_MAGIC, META_VERSION, op, len(payload)) + payload


def decode_edits(data: bytes) -> Iterator[tuple[int, int, int | None]]:
    """Edits; a torn tail is ignored, a wrong magic, version, op or size fails."""
    at = 0
    while at + 13 <= len(data):
        magic, version, op, size = struct.unpack_from("<IIBI", data, at)
        if magic != META_MAGIC or version != META_VERSION or op not in (1, 2, 3, 4, 5) or size != (12 if op == 2 else 8):
            raise ValueError("damaged metadata edit")
        if at + 13 + size > len(data):
            return
        number = struct.unpack_from("<Q", data, at + 13)[0]
        yield op, number, struct.unpack_from("<I", data, at + 21)[0] if op == 2 else None
        at += 13 + size


def encode_snapshot(next_file: int, runs: dict[int, int], wals: list[int]) -> bytes:
    head = struct.pack("<IIQI", META_MAGIC, META_VERSION, next_file, len(runs))
    return head + b"".join(struct.pack("<QI", i, runs[i]) for i in sorted(runs)) + struct.pack("<I", len(wals)) + b"".join(struct.pack("<Q", i) for i in sorted(wals))


def decode_snapshot(data: bytes) -> tuple[int, dict[int, int], list[int]]:
    try:
        magic, version, next_file, n = struct.unpack_from("<IIQI", data, 0)
        if magic != META_MAGIC or version != META_VERSION:
            raise ValueError("not a snapshot")
        runs = dict(struct.unpack_from("<QI", data, 20 + 12 * k) for k in range(n))
        at = 20 + 12 * n
        (m,) = struct.unpack_from("<I", data, at)
        return next_file, runs, list(struct.unpack_from(f"<{m}Q", data, at + 4))
    except struct.error:
        raise ValueError("short snapshot") from None


class RunFile:
    """Random access to one run: footer and index at opening, filter and blocks when asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(min(40, size), max(0, size - 40))
        at, n, self.filter_at, self.filter_size = decode_footer(tail)
        if at + n > size or self.filter_at + self.filter_size > size:
            raise ValueError("a run's index and filter lie within the file")
        self.index = _index(file.read_at(n, at), size)
        self.last_keys = [k for k, _, _ in self.index]

    def filter(self) -> bytes:
        return self.file.read_at(self.filter_size, self.filter_at) if self.filter_size else b""

    def block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        _, at, n = self.index[k]
        yield from _entries(self.file.read_at(n, at))

    def find(self, keys: set[bytes]) -> Iterator[tuple[bytes, int, bytes]]:
        """Records of ``keys``: filter, then index, then the one block that can hold each. A run without filter passes all."""
        data = self.filter()
        wanted: dict[int, set[bytes]] = {}
        for key in keys:
            if not data or bloom.may_hold(data, key):
                wanted.setdefault(bisect.bisect_left(self.last_keys, key), set()).add(key)
        for k in sorted(wanted):
            if k < len(self.index):
                yield from (r for r in self.block(k) if r[0] in wanted[k])

    def scan(self, low: bytes | None, high: bytes | None, part: int, parts: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Records of the blocks that may hold keys from ``low`` to ``high``, both included; the ``part``-th share of the data."""
        first = bisect.bisect_left(self.last_keys, low) if low is not None else 0
        last = min(bisect.bisect_left(self.last_keys, high), len(self.index) - 1) if high is not None else len(self.index) - 1
        for k in range(first, last + 1):
            if self.index[k][1] * parts // max(1, self.filter_at) == part:
                yield from self.block(k)


class _File(InputPartition):
    def __init__(self, path: str, number: int, part: int = 0, parts: int = 1):
        self.path, self.number, self.part, self.parts = path, number, part, parts


class _Files(DataSourceReader):
    """Files ``<number><suffix>`` of a folder, in numeric order; other names are ignored."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def listed(self):
        """(number, path, bytes) of each file."""
        fs, root = open_fs(self.folder)
        found = [(m, x) for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if (m := re.fullmatch(rf"(\d+){re.escape(self.suffix)}", x.base_name))]
        return sorted((int(m[1]), x.path, x.size) for m, x in found)

    def partitions(self):
        return [_File(path, n) for n, path, _ in self.listed()] or [_File("", 0)]


class _LogReader(_Files):
    """One partition for each log: its records' checksums hold in order only."""

    def read(self, partition):
        if partition.path:
            fs, _ = open_fs(self.folder)
            size = fs.get_file_info(partition.path).size
            with fs.open_input_stream(partition.path, compression=None) as f:
                for k, (op, key, value) in enumerate(stream_log(iter(lambda: f.read(CHUNK), b""), size)):
                    yield partition.number, k, op, key, value


class _RunReader(_Files):
    """Equality and IN on the key are answered by filter, index and single blocks; bounds choose blocks and are checked again by Spark."""

    def __init__(self, folder: str, what: str, range_bytes: int):
        super().__init__(folder, ".sst")
        self.what, self.range_bytes, self.keys, self.low, self.high = what, range_bytes, None, None, None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if self.what != "records" or getattr(f, "attribute", None) != ("key",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                keys = {bytes(v) for v in ((f.value,) if isinstance(f, EqualTo) else f.value) if v is not None}
                self.keys = keys if self.keys is None else self.keys & keys
            else:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low or b"", bytes(f.value))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(bytes(f.value), self.high) if self.high is not None else bytes(f.value)
                yield f

    def partitions(self):
        cut = self.what == "records" and self.keys is None
        out = [_File(path, n, k, parts) for n, path, size in self.listed() for parts in [max(1, -(-size // self.range_bytes)) if cut else 1] for k in range(parts)]
        return out or [_File("", 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = open_fs(self.folder)
        with fs.open_input_file(partition.path) as f:
            run, n = RunFile(f), partition.number
            if self.what == "index":
                yield from ((n, k, key, at, size) for k, (key, at, size) in enumerate(run.index))
            elif self.what == "filter":
                yield n, run.filter()
            else:
                found = run.find(self.keys) if self.keys is not None else run.scan(self.low, self.high, partition.part, partition.parts)
                yield from ((n, *r) for r in found)


class _Made(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Writer(DataSourceWriter):
    """A file for each number, written under another name by one task and renamed at commit, so a lost attempt leaves no file."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def write(self, iterator):
        fs, root = open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        made, number, out, add = [], None, None, None

        def close():
            if out is not None:
                add(None)
                out.close()

        for row in iterator:
            if row[0] != number:
                close()
                number = row[0]
                name = f"{root}/.{uuid.uuid4().hex}"
                out = fs.open_output_stream(name, compression=None)
                made.append((name, f"{root}/{number}{self.suffix}"))
                add = self._start(out)
            add(row)
        close()
        return _Made(made)

    def _start(self, out):
        raise NotImplementedError

    def commit(self, messages):
        fs, _ = open_fs(self.folder)
        made = [x for m in messages if m for x in m.files]
        names = [final for _, final in made]
        there = [x.path for x in fs.get_file_info(names) if x.type != pafs.FileType.NotFound] if names else []
        if len(set(names)) < len(names) or there:
            self.abort(messages)
            raise ValueError(f"files that exist, or rows of one number in several tasks: {there or 'see the input'}")
        for ready, final in made:
            fs.move(ready, final)

    def abort(self, messages):
        fs, _ = open_fs(self.folder)
        for m in messages:
            for ready, _ in m.files if m else []:
                fs.delete_file(ready)


class _LogWriter(_Writer):
    def _start(self, out):
        return lambda row: row and out.write(encode_log_record(row[2], bytes(row[3]), bytes(row[4])))


class _RunWriter(_Writer):
    def _start(self, out):
        builder = RunBuilder(out.write)
        return lambda row: builder.add(bytes(row[1]), row[2], bytes(row[3])) if row else builder.finish()


class LogSource(DataSource):
    """``format("mutation_wal")``: all records of a folder's ``<id>.wal`` files; written by rows clustered by log and sorted by ordinal."""

    @classmethod
    def name(cls):
        return "mutation_wal"

    def schema(self):
        return "wal_id long, ordinal long, op int, key binary, value binary"

    def reader(self, schema):
        return _LogReader(self.options["path"], ".wal")

    def writer(self, schema, overwrite):
        return _LogWriter(self.options["path"], ".wal")


class RunSource(DataSource):
    """``format("sorted_run")``: all records, tombstones included, of a folder's ``<id>.sst`` files.

    Option ``index`` gives the sparse index, ``filter`` the filters' bytes; ``range_bytes`` is the share of a run that a task reads. Written by rows clustered by run and sorted by key.
    """

    @classmethod
    def name(cls):
        return "sorted_run"

    def _what(self) -> str:
        return next((k for k in ("index", "filter") if self.options.get(k, "false") == "true"), "records")

    def schema(self):
        return {"index": "run long, block long, last_key binary, offset long, bytes long", "filter": "run long, data binary", "records": "run long, key binary, op int, value binary"}[self._what()]

    def reader(self, schema):
        return _RunReader(self.options["path"], self._what(), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite):
        return _RunWriter(self.options["path"], ".sst")


class _EditReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def read(self, partition):
        fs, path = open_fs(self.path)
        with fs.open_input_stream(path, compression=None) as f:
            for k, (op, number, level) in enumerate(decode_edits(f.read())):
                yield k, op, number, level


class EditSource(DataSource):
    """``format("metadata_edits")``: the edits of one metadata log file."""

    @classmethod
    def name(cls):
        return "metadata_edits"

    def schema(self):
        return "edit_seq long, op int, id long, level long"

    def reader(self, schema):
        return _EditReader(self.options["path"])


def read_native(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """Native files as a table; the session setting that lets key predicates reach the reader is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LogSource, RunSource, EditSource):
        spark.dataSource.register(source)
    return spark.read.format(kind).options(**options).load(path)


def write_native_logs(records: DataFrame, path: str) -> None:
    """New logs from ``wal_id``, ``ordinal``, ``op``, ``key``, ``value``; a log is one sequence of bytes, so one task writes it."""
    records.sparkSession.dataSource.register(LogSource)
    rows = records.select(F.col("wal_id").cast("long"), F.col("ordinal").cast("long"), F.col("op").cast("int"), F.col("key").cast("binary"), F.col("value").cast("binary"))
    rows.repartition("wal_id").sortWithinPartitions("wal_id", "ordinal").write.format("mutation_wal").mode("append").save(path)


def write_native_runs(rows: DataFrame, path: str) -> None:
    """New runs from ``run``, ``key``, ``op``, ``value`` (a key once in a run); a run is one file, so one task writes it."""
    rows.sparkSession.dataSource.register(RunSource)
    rows = rows.select(F.col("run").cast("long"), F.col("key").cast("binary"), F.col("op").cast("int"), F.col("value").cast("binary"))
    rows.repartition("run").sortWithinPartitions("run", "key").write.format("sorted_run").mode("append").save(path)


class Metadata:
    """The metadata of a folder: a snapshot and a log of later edits. Small, and kept by one writer."""

    def __init__(self, folder: str):
        self.fs, self.root = open_fs(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.next, self.runs, self.wals, self.logged = 0, {}, set(), 0
        if (data := self._read("MANIFEST")) is not None:
            self.next, self.runs, wals = decode_snapshot(data)
            self.wals = set(wals)
        for edit in decode_edits(self._read("MANIFEST.log") or b""):
            self._apply(*edit)
            self.logged += 1

    def _read(self, name: str) -> bytes | None:
        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path, compression=None) as f:
            return f.read()

    def _replace(self, name: str, data: bytes) -> None:
        ready = f"{self.root}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(ready, compression=None) as out:
            out.write(data)
        self.fs.move(ready, f"{self.root}/{name}")

    def _apply(self, op: int, number: int, level: int | None) -> None:
        if op == ADD_RUN:
            self.runs[number] = level
        elif op == DROP_RUN:
            self.runs.pop(number, None)
        elif op == ADD_WAL:
            self.wals.add(number)
        elif op == DROP_WAL:
            self.wals.discard(number)
        else:
            self.next = number

    def edit(self, op: int, number: int, level: int | None = None) -> bool:
        """Log and apply an edit; false, without a trace, for a log that is there already or one to drop that is not.

        Every ``CHECKPOINT_EDITS`` edits a snapshot is written and the log emptied.
        """
        if op in (ADD_WAL, DROP_WAL) and (number in self.wals) == (op == ADD_WAL):
            return False
        whole = self._read("MANIFEST.log") or b""
        self._replace("MANIFEST.log", whole + encode_edit(op, number, level))
        self._apply(op, number, level)
        self.logged += 1
        if self.logged >= CHECKPOINT_EDITS:
            self.checkpoint()
        return True

    def checkpoint(self) -> None:
        """Snapshot first, then an empty log: after a failure between the two the edits are applied once more, to the same end."""
        self._replace("MANIFEST", encode_snapshot(self.next, self.runs, sorted(self.wals)))
        self._replace("MANIFEST.log", b"")
        self.logged = 0
