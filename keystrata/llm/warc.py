"""WARC archives as a PySpark data source: ``format("warc")`` writes and reads them.

Each record is a gzip member whose extra field holds the member's length, so a reader that does not want a record's
payload steps over it after its headers. Files are planned as ranges at the record places that the manifest lists;
foreign archives (no manifest, ``.warc`` or ``.warc.gz``) are read file by file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .tokens import open_fs

#: Compressed bytes after which a new range of a file begins.
RANGE_BYTES = 32 << 20
#: Bytes of a member that are read to get at its headers; the rest is read only for a payload that is asked for.
HEAD_BYTES = 4096
#: Headers of a foreign record end within so many bytes, else the file counts as torn there.
MOST_HEADER = 1 << 20
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length"}
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, content_length long, payload binary, measured_bytes long, measured_digest string"


def _member(data: bytes) -> bytes:
    """One gzip member that states its own length (subfield ``KL``)."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"KL", 8, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(row: dict) -> bytes:
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


class _Written(WriterCommitMessage):
    def __init__(self, entry: dict | None):
        self.entry = entry


class _Writer(DataSourceArrowWriter):
    """A file for each task; a manifest of its own for each commit lists those of successful tasks only."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        name, out, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        for batch in iterator:
            for lo in range(0, batch.num_rows, 64):
                for row in batch.slice(lo, 64).to_pylist():
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed already
                    data = _record(row)
                    if at - splits[-1] >= RANGE_BYTES:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        if out is None:
            return _Written(None)
        out.close()
        return _Written({"file": name, "bytes": at, "splits": splits})

    def commit(self, messages) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        older = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.entry for m in messages if m and m.entry]).encode())
        for path in older:
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            if m and m.entry:
                fs.delete_file(f"{root}/{m.entry['file']}")


def _manifests(fs, root: str) -> list[str]:
    return sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if re.fullmatch(r"manifest-[0-9a-f]{32}\.json", x.base_name))


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"[0-9]{1,18}", value) else None


class _Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int | None):
        self.file, self.begin, self.end = file, begin, end


def _headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class _Reader(DataSourceReader):
    """Parses headers first; a record that fails a pushed predicate, or whose payload is not asked for, is stepped over."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.wanted = path, columns, {}
        self.decodes = bool({"payload", "measured_bytes", "measured_digest"} & {*columns})

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in _HEADERS and column != "payload_bytes" and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        fs, root = open_fs(self.path)
        if manifests := _manifests(fs, root):
            listed = []
            for path in manifests:
                with fs.open_input_stream(path) as f:
                    listed += json.loads(f.read())
            ranges = [_Range(x["file"], a, b) for x in listed for a, b in zip(x["splits"], [*x["splits"][1:], x["bytes"]], strict=True)]
        else:
            files = fs.get_file_info(pafs.FileSelector(root))
            ranges = [_Range(x.base_name, 0, None) for x in files if re.search(r"\.warc(\.gz)?$", x.base_name)]
        return ranges or [_Range("", 0, 0)]

    def _row(self, head: dict[str, str], block) -> tuple | None:
        found = {c: head.get(h.lower()) for c, h in _HEADERS.items()}
        for c in ("record_id", "refers_to"):
            found[c] = found[c] and found[c].strip("<>")
        if found["payload_digest"]:
            found["payload_digest"] = found["payload_digest"].partition(":")[2]
        if any(found[c] not in values for c, values in self.wanted.items()):
            return None
        found["payload_bytes"] = _number(found["payload_bytes"])
        found["content_length"] = _number(head.get("content-length")) or 0
        if self.decodes and found["record_type"] != "revisit":
            data = block()
            if head.get("content-type", "").startswith("application/http"):
                data = data.partition(b"\r\n\r\n")[2]
            found |= {"payload": data, "measured_bytes": len(data)}
            if "measured_digest" in self.columns:
                found["measured_digest"] = base64.b32encode(hashlib.sha1(data).digest()).decode()
        return tuple(found.get(c) for c in self.columns)

    def read(self, partition):
        if not partition.file:
            return
        fs, root = open_fs(self.path)
        path = f"{root}/{partition.file}"
        if partition.end is not None:
            yield from self._own(fs.open_input_file(path), partition.begin, partition.end)
        else:
            yield from self._foreign(fs.open_input_stream(path, compression=None), partition.file.endswith(".gz"))

    def _own(self, file, at: int, end: int):
        whole = self.decodes and not self.wanted
        while at < end:
            raw = file.read_at(24 + HEAD_BYTES, at)
            size = struct.unpack("<Q", raw[16:24])[0]
            body = raw[24 : size - 8]
            if whole and len(body) < size - 32:
                body += file.read_at(size - 32 - len(body), at + 24 + len(body))
            inflate = zlib.decompressobj(-15)
            text = inflate.decompress(body, 4096)
            read = len(body)
            while b"\r\n\r\n" not in text:
                if inflate.unconsumed_tail:
                    text += inflate.decompress(inflate.unconsumed_tail, 4096)
                else:  # headers of more than HEAD_BYTES, compressed
                    more = file.read_at(min(HEAD_BYTES, size - 32 - read), at + 24 + read)
                    read += len(more)
                    text += inflate.decompress(more, 4096)
            cut = text.index(b"\r\n\r\n")
            head = _headers(text[:cut])

            def block(text=text, cut=cut, inflate=inflate, head=head, read=read, at=at, size=size):
                rest = file.read_at(size - 32 - read, at + 24 + read) if read < size - 32 else b""
                whole = text[cut + 4 :] + inflate.decompress(inflate.unconsumed_tail + rest) + inflate.flush()
                return whole[: int(head["content-length"])]

            if (row := self._row(head, block)) is not None:
                yield row
            at += size

    def _foreign(self, raw, zipped: bool):
        stream = gzip.GzipFile(fileobj=raw) if zipped else raw
        held = b""
        while True:
            while b"\r\n\r\n" not in held.lstrip(b"\r\n"):
                more = stream.read(1 << 16)
                if not more or len(held) > MOST_HEADER:
                    return
                held += more
            held = held.lstrip(b"\r\n")
            text, _, held = held.partition(b"\r\n\r\n")
            head = _headers(text)
            left, parts = _number(head.get("content-length", "0")), []
            if left is None:
                return  # where the next record begins is not known
            while left > 0:
                if not held:
                    held = stream.read(min(1 << 20, left + (1 << 12)))
                    if not held:
                        return  # a torn last record
                if self.decodes:
                    parts.append(held[:left])
                take = min(left, len(held))
                held, left = held[take:], left - take
            if (row := self._row(head, lambda parts=parts: b"".join(parts))) is not None:
                yield row


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], schema.names)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of the archives below ``path``. Leave ``payload`` and the measured columns out of ``schema`` to skip decoding payloads.

    ``measured_bytes`` and ``measured_digest`` (base32 SHA-1) are those of the payload as it was decoded, null for a revisit. A
    foreign file ends at a record whose headers are damaged or whose body is torn.

    Equality and IN predicates on header columns reach the reader; the session setting that this needs is switched on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows to write: a response for each payload (the page of largest id), a revisit for every other page with it.

    Null html is an empty payload; a null id is less than any id and is written as ``urn:page:null``. Of several
    rows that share a payload and the largest id, those of the largest url hash are responses. Groups are found by SHA-1 with partial aggregates;
    a payload held by a third of all pages is one row there, and its pages meet that row over salted keys.
    """
    raw = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), raw.alias("payload"), F.sha1(raw).alias("digest"), F.xxhash64(F.col(url_col)).alias("tie"))
    order = F.struct(F.coalesce(F.col("id"), F.lit(-(1 << 63))), "tie")
    first = rows.groupBy("digest").agg(F.max(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    salted = first.select("digest", F.col("first").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("id", "tie"), F.lit(16)).cast("int")).join(salted, ["digest", "salt"], "left")
    chief = F.col("first").isNull() | (F.col("first") == order)
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    first_id = F.col("first")["col1"]
    target = F.concat(F.lit("urn:page:"), F.when(first_id == -(1 << 63), "null").otherwise(first_id.cast("string")))
    return met.select(name.alias("record_id"), F.when(chief, "response").otherwise("revisit").alias("record_type"), "target_uri", F.when(chief, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest"), F.when(~chief, target).alias("refers_to"))


def write_pages(pages: DataFrame, path: str, **columns: str) -> None:
    """Write the pages' records as archives below ``path``. An empty table gives an empty manifest."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    records = page_records(pages, **columns)

    def base32(batches):
        for batch in batches:
            hexed = batch.column("digest").to_pylist()
            digest = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in hexed], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("record_id", "record_type", "target_uri", "payload", "payload_bytes")), digest, batch.column("refers_to")], names=["record_id", "record_type", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to"])

    shaped = records.mapInArrow(base32, "record_id string, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to string")
    shaped.write.format("warc").mode("append").save(path)
