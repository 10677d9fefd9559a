"""Token-id shards: one zstandard frame per document, a dictionary shared by all, an index for single documents.

A shard file holds the magic, the SHA-256 of the dictionary, the frames in ascending document order, then the index
(an Arrow table: doc_id, offset, length, n_tokens) and an eight-byte place of the index with the magic again. The
dictionary lies beside the shards under its hash; ``manifest.json`` lists the shards that successful tasks wrote, so
files of lost or repeated attempts are never read. Ids are little-endian, two bytes when the vocabulary allows.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import json
import threading
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ._store import Scratch

MAGIC = b"KSTOK1\0\0"
#: The dictionary is trained on at most this many whole documents, of at most so many UTF-8 bytes each.
SAMPLE_DOCS, SAMPLE_DOC_BYTES, DICTIONARY_BYTES = 1500, 16_384, 65_536
#: Distinct words whose ids a worker remembers before it starts afresh, the same of words that no row of the table holds,
#: and the most bytes of a remembered one.
MEMO, MEMO_LONG, MEMO_CHARS = 450_000, 50_000, 48
#: A worker that has had no task of this module for so many seconds gives the memory of its encoder back.
IDLE_SECONDS = 2.0


def open_fs(path: str):
    """(filesystem, path in it) of a URI or a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Words:
    """Hash table of words with their ids, for whole arrays of words at once.

    A word is a row of ``COLUMNS`` numbers: the byte of the separator before it and its UTF-8 bytes, filled up with zeros
    to ``WIDTH``. Rows are compared whole, so no two words are taken for each other. Slots are probed in order and are at
    least twice as many as the words.
    """

    COLUMNS, WIDTH = 3, 24
    _mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __init__(self, dtype: np.dtype):
        self.count, self.used = 0, 0
        self.keys = [np.zeros(1 << 16, np.uint64) for _ in range(self.COLUMNS)]
        self.slot_word = np.zeros(1 << 16, np.int32)
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.ids = np.zeros(1 << 17, dtype)
        self.add(self.bare(1), self.ids[:0], np.zeros(1, np.int32))

    @classmethod
    def bare(cls, n: int) -> list[np.ndarray]:
        """Rows of the empty first word of a text that begins with a separator: it has no ids."""
        return [np.full(n, k == 0, np.uint64) for k in range(cls.COLUMNS)]

    def _slots(self, rows: list[np.ndarray]) -> np.ndarray:
        h = rows[0] * self._mix[0]
        for column, factor in zip(rows[1:], self._mix[1:], strict=True):
            h ^= h >> np.uint64(32)
            h += column
            h *= factor
        return (h >> np.uint64(64 - self.slot_word.size.bit_length() + 1)).astype(np.int64)

    def find(self, rows: list[np.ndarray]) -> np.ndarray:
        """Numbers of the words, -1 for unknown ones."""
        slots = self._slots(rows)
        same = self.keys[0][slots] == rows[0]
        for key, column in zip(self.keys[1:], rows[1:], strict=True):
            same &= key[slots] == column
        found = np.where(same, self.slot_word[slots], -1)
        todo = np.flatnonzero(~same)
        slots = slots[todo]
        while todo.size:
            taken = self.keys[0][slots] != 0  # an empty slot ends a search; a separator is never zero
            todo, slots = todo[taken], (slots[taken] + 1) & (self.slot_word.size - 1)
            same = np.ones(todo.size, bool)
            for key, column in zip(self.keys, rows, strict=True):
                same &= key[slots] == column[todo]
            found[todo[same]] = self.slot_word[slots[same]]
            todo, slots = todo[~same], slots[~same]
        return found

    def _place(self, rows: list[np.ndarray], words: np.ndarray) -> None:
        """Put numbers of words into the slots of their rows."""
        slots, todo = self._slots(rows), np.arange(words.size)
        while todo.size:
            free = self.keys[0][slots] == 0
            at = slots[free]
            self.slot_word[at] = words[todo[free]]  # of several for one slot the last stays
            won = np.zeros(todo.size, bool)
            won[free] = self.slot_word[at] == words[todo[free]]
            for key, column in zip(self.keys, rows, strict=True):
                key[slots[won]] = column[todo[won]]
            todo, slots = todo[~won], (slots[~won] + 1) & (self.slot_word.size - 1)

    def add(self, rows: list[np.ndarray], ids: np.ndarray, length: np.ndarray) -> None:
        """Words that are not in the table and differ from each other; ``ids`` are theirs, one word's after the other's."""
        n = rows[0].size
        while 2 * (self.count + n) > self.slot_word.size:
            held = np.flatnonzero(self.keys[0])
            kept, words = [key[held] for key in self.keys], self.slot_word[held]
            self.keys = [np.zeros(2 * self.slot_word.size, np.uint64) for _ in self.keys]
            self.slot_word = np.zeros(2 * self.slot_word.size, np.int32)
            self._place(kept, words)
        while self.count + n > self.start.size:
            self.start, self.length = np.append(self.start, self.start), np.append(self.length, self.length)
        while self.used + ids.size > self.ids.size:
            self.ids = np.append(self.ids, self.ids)
        self._place(rows, np.arange(self.count, self.count + n, dtype=np.int32))
        self.start[self.count : self.count + n] = self.used + np.cumsum(length) - length
        self.length[self.count : self.count + n] = length
        self.ids[self.used : self.used + ids.size] = ids
        self.count, self.used = self.count + n, self.used + ids.size

    def words(self) -> list[bytes]:
        """All words, each after its separator."""
        held = np.flatnonzero(self.keys[0])
        return [r.tobytes().rstrip(b"\0") for r in np.stack([key[held] for key in self.keys], 1)]


def _spans(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Those ids that stand in the given places, one after the other; places past the end give any."""
    return ids.take(np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum()), mode="clip")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them (no special tokens added); those of words seen before are remembered.

    A byte-level tokenizer joins nothing across a single space or line feed between two other characters: a space
    opens the next piece, a line feed is a piece of its own. Texts are cut there, unknown words are encoded together
    in one call and cut by their byte lengths. A text with adjacent or unusual white space, or with the string of an added
    token, is encoded in one piece, and so is every text where the tokenizer is of another kind (``cuts`` is false).
    Words are kept with the separator before them, a text's first with the byte 1.
    """

    _masks = [np.array([(1 << 8 * min(max(n - 8 * k, 0), 8)) - 1 for n in range(_Words.WIDTH + 1)], np.uint64) for k in range(_Words.COLUMNS)]
    #: Of each byte: 1 is a separator, 2 other white space, 3 may begin white space of two or three bytes (``_white``).
    _class = np.zeros(256, np.uint8)
    _class[[0x20, 0x0A, 0x01]] = 1
    _class[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = 2
    _class[[0xC2, 0xE1, 0xE2, 0xE3]] = 3
    _white = np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        told = json.loads(self.model.to_str())
        pieces, model = told["pre_tokenizer"] or {}, told["model"]
        plain = not any(told[k] for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout"))
        self.cuts = plain and model.get("type") == "BPE" and pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space", True)
        self.added = [t["content"] for t in told["added_tokens"]]
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if max(vocab.values(), default=0) < 1 << 16 else np.dtype("<u4")
        self.byte_length = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.byte_length[i] = len(token)
        self.table, self.old = _Words(self.dtype), _Words(self.dtype)  # two generations: words in use outlive a change
        self.long: dict[bytes, np.ndarray] = {}  # words that no row holds

    @property
    def young(self) -> set[str]:
        """Words that are remembered, without their separators."""
        return {w[1:].decode() for w in [*self.table.words(), *self.long]}

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words that lie one after the other, each with the separator before it."""
        ends = np.cumsum(sizes)
        first = np.frombuffer(words, np.uint8)[ends - sizes] == 1
        ids = np.array(self.model.encode_batch_fast([words.replace(b"\1", b"\n").decode()], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.searchsorted(np.cumsum(self.byte_length[ids]), ends, "left") + 1
        start = np.append(0, cuts[:-1]) + first  # nothing stands before a text's first word: less the line feed
        return _spans(ids, start, cuts - start), cuts - start

    def _numbers(self, rows: list[np.ndarray]) -> np.ndarray:
        """Numbers in the table of words, which all are in it afterwards."""
        number = self.table.find(rows)
        missing = np.flatnonzero(number < 0)
        if missing.size:
            lost = [r[missing] for r in rows]
            order = np.lexsort(lost)
            new = [r[order] for r in lost]
            distinct = np.append(True, np.any([r[1:] != r[:-1] for r in new], 0))
            new = [r[distinct] for r in new]
            held = self.old.find(new)
            known, fresh = np.flatnonzero(held >= 0), np.flatnonzero(held < 0)
            length = self.old.length[held[known]]
            self.table.add([r[known] for r in new], _spans(self.old.ids, self.old.start[held[known]], length), length)
            for at in range(0, fresh.size, 8192):
                part = [r[fresh[at : at + 8192]] for r in new]
                text = np.stack(part, 1).astype("<u8").view(np.uint8)
                self.table.add(part, *self._learn(text[text != 0].tobytes(), np.count_nonzero(text, 1)))
            number[missing] = self.table.find(lost)
        return number

    def _long(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that no row holds."""
        new, found = [w for w in dict.fromkeys(words) if w not in self.long], {}
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            ids, length = self._learn(b"".join(part), np.array([len(w) for w in part]))
            found.update((w, ids[e - n : e].copy()) for w, e, n in zip(part, np.cumsum(length).tolist(), length.tolist(), strict=True))
        out = [found[w] if w in found else self.long[w] for w in words]
        self.long.update((w, ids) for w, ids in found.items() if len(w) <= MEMO_CHARS + 1)
        return out

    def _cut(self, raw: bytes) -> list[bytes | None]:
        """Serialized ids of texts that each follow a byte 1; None for one that must not be cut."""
        padded = raw + bytes(_Words.WIDTH)
        data = np.frombuffer(padded, np.uint8)
        kind = self._class[data]
        starts = np.flatnonzero(kind == 1)
        sizes = np.diff(starts, append=len(raw))
        first = data[starts] == 1
        odd = (sizes == 1) & ~first
        lead = np.flatnonzero(kind == 3)
        two = data[lead].astype(np.int64) << 8 | data[lead + 1]
        white = lead[np.isin(two, self._white) | np.isin(two << 8 | data[lead + 2], self._white)]
        odd[np.searchsorted(starts, np.append(np.flatnonzero(kind == 2), white), "right") - 1] = True
        text = np.cumsum(first) - 1
        whole = np.bincount(text[odd], minlength=int(text[-1]) + 1) > 0
        if whole.any():
            cut = ~whole[text]
            starts, sizes, first = starts[cut], sizes[cut], first[cut]
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        rows = [eight[starts + 8 * k] & mask[np.minimum(sizes, _Words.WIDTH)] for k, mask in enumerate(self._masks)]
        long = np.flatnonzero(sizes > _Words.WIDTH)
        for r, none in zip(rows, _Words.bare(1), strict=True):
            r[long] = none
        number = self._numbers(rows)
        length = self.table.length[number].astype(np.int64)
        others = self._long([raw[a : a + n] for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)])
        length[long] = [len(x) for x in others]
        ids = _spans(self.table.ids, self.table.start[number], length)
        ends = np.cumsum(length)
        for e, x in zip(ends[long].tolist(), others, strict=True):
            ids[e - len(x) : e] = x
        data, width = ids.tobytes(), self.dtype.itemsize
        begins = [*((ends - length)[first] * width).tolist(), len(data)]
        made = map(data.__getitem__, map(slice, begins, begins[1:]))
        return [None if w else next(made) for w in whole.tolist()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Serialized ids of each text; none for a null or empty one."""
        if self.table.count > MEMO:
            self.table, self.old = _Words(self.dtype), self.table
        if len(self.long) > MEMO_LONG:
            self.long = {}
        cut = [bool(t) and self.cuts and "\0" not in t and "\1" not in t and not any(a in t for a in self.added) for t in texts]
        raw = "".join(["\1" + t for t, c in zip(texts, cut, strict=True) if c]).encode()
        made = iter(self._cut(raw) if raw else [])
        got = [next(made) if c else None for c in cut]
        return [b"" if not t else self._whole(t) if x is None else x for t, x in zip(texts, got, strict=True)]


@functools.lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """The encoder of a worker process: tasks that run in it one after the other share the words it has learnt."""
    return Encoder(path)


_borrowed = 0


@contextlib.contextmanager
def borrowed_encoder(path: str):
    """The worker's encoder for one task. Spark keeps idle workers for other stages, whose memory it must not hold."""
    global _borrowed
    _borrowed += 1
    try:
        yield encoder_for(path)
    finally:
        timer = threading.Timer(IDLE_SECONDS, _release, [_borrowed])
        timer.daemon = True
        timer.start()


def _release(last: int) -> None:
    """Forget the encoder unless another task came; one that is in use stays with its task."""
    if last == _borrowed:
        encoder_for.cache_clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


def _groups(batch: pa.RecordBatch, most: int = 1 << 20):
    """Slices of rows with about ``most`` bytes of text, or of one longer row."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        before = lengths[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(lengths, before + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample: those of least hash of id and text.

    Too few or too small samples give a raw dictionary of their bytes, none gives an empty one; both are valid. The
    driver sees the sample's hashes and the dictionary; texts are sampled by hash and trained on in one task.
    """
    short = docs.select(F.xxhash64(id_col, text_col).alias("hash"), F.col(text_col).alias("text")).where(F.octet_length(text_col).between(1, SAMPLE_DOC_BYTES))
    hashes = [r[0] for r in short.select("hash").orderBy("hash").limit(SAMPLE_DOCS).collect()]
    if not hashes:
        return b""

    def train(batches):
        import zstandard

        texts = sorted((h, t) for b in batches for h, t in zip(b.column("hash").to_pylist(), b.column("text").to_pylist(), strict=True))[:SAMPLE_DOCS]
        with borrowed_encoder(tokenizer) as encoder:
            end = np.array([end_id], encoder.dtype).tobytes()
            samples = [x + end for x in encoder.encode([t for _, t in texts])]
        try:
            data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            data = b"".join(samples)[-DICTIONARY_BYTES:]
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    # copies beyond the sample's number can share the last hash: no more than those of one text are added
    sample = short.where(F.col("hash") <= hashes[-1]).groupBy("hash").agg(F.min("text").alias("text"))
    return bytes(sample.repartition(1).mapInArrow(train, "data binary").first().data)


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", level: int = 3, order_col: str | None = None) -> None:
    """Encode every text, end it with ``end_id`` and write shards in ascending order of ``order_col``, if given, then id, nulls first.

    Equal ids and repeated rows each get a frame, in the order of their texts' hashes. A null or empty text is the end id
    alone. An empty table gives a manifest without shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    digest = hashlib.sha256(data).digest()
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{digest.hex()}.dict") as out:
        out.write(data)

    def write(batches):
        with borrowed_encoder(tokenizer) as encoder:
            yield from write_with(encoder, batches)

    def write_with(encoder, batches):
        import zstandard

        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        frames = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(data), write_content_size=True)
        fs, root = open_fs(path)
        part = TaskContext.get().partitionId()
        name, out, at, total = f"shard-{part:06d}-{uuid.uuid4().hex}.kst", None, len(MAGIC) + 32, 0
        index: list[tuple] = []
        for batch in batches:
            for rows in _groups(batch):
                for i, ids in zip(rows.column("id").to_pylist(), encoder.encode(rows.column("text").to_pylist()), strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC + digest)
                    frame = frames.compress(ids + end)
                    out.write(frame)
                    n = len(ids) // width + 1
                    index.append((i, at, len(frame), n))
                    at += len(frame)
                    total += n
        if out is None:
            return
        sink = pa.BufferOutputStream()
        table = pa.table([pa.array(x, t) for x, t in zip(zip(*index, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "offset", "length", "n_tokens"])
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        out.write(sink.getvalue())
        out.write(at.to_bytes(8, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(index)]), pa.array([total]), pa.array([width])], names=["part", "file", "docs", "tokens", "width"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), *([F.col(order_col).alias("place")] if order_col else []))
    order = ["place"] * bool(order_col) + ["id", "tie"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    shards = ordered.mapInArrow(write, "part long, file string, docs long, tokens long, width long")
    store = Scratch(spark, "tokens")
    made = sorted(store.keep(shards, "shards").collect(), key=lambda r: r.part)  # one small row for each shard
    store.drop("shards")
    start, listed = 0, []
    for r in made:
        listed.append({"file": r.file, "docs": r.docs, "tokens": r.tokens, "start": start})
        start += r.tokens
    manifest = {"dictionary": digest.hex(), "end_id": end_id, "width": made[0].width if made else 2, "shards": listed}
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())


def _manifest(path: str) -> dict:
    fs, root = open_fs(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class _Shard:
    """Random access to one shard file."""

    def __init__(self, path: str, name: str, dictionary: str):
        import zstandard

        fs, root = open_fs(path)
        with fs.open_input_stream(f"{root}/{dictionary}.dict") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != dictionary:
            raise ValueError(f"{root}: the dictionary does not have the hash of its name")
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if tail[8:] != MAGIC or head != MAGIC + bytes.fromhex(dictionary):
            raise ValueError(f"{name}: not a shard of this dictionary")
        at = int.from_bytes(tail[:8], "little")
        self.index = pa.ipc.open_stream(self.file.read_at(size - 16 - at, at)).read_all()
        self.frames = zstandard.ZstdDecompressor(dict_data=_dictionary(data))

    def ids(self, offset: int, length: int, width: int) -> np.ndarray:
        return np.frombuffer(self.frames.decompress(self.file.read_at(length, offset)), f"<u{width}").astype("<u4")


def read_document(path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents of one id: reads the shards' indexes and those documents' frames only."""
    m, out = _manifest(path), []
    for s in m["shards"]:
        shard = _Shard(path, s["file"], m["dictionary"])
        hit = shard.index.filter(pc.equal(shard.index["doc_id"], doc_id))
        out += [shard.ids(r["offset"], r["length"], m["width"]).tolist() for r in hit.to_pylist()]
    return out


def _schema(with_ids: bool) -> str:
    return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")


def _shard_rows(path: str, manifest: dict, file: str, start: int, with_ids: bool):
    """Batches of a shard's documents; ``start``: ids of all documents in the shards before."""
    shard, width = _Shard(path, file, manifest["dictionary"]), manifest["width"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    for batch in shard.index.to_batches(max_chunksize=512):
        count = batch.column("n_tokens").to_numpy()
        starts = start + np.cumsum(count) - count
        start += int(count.sum())
        ids = [shard.ids(o, n, width) for o, n in zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True)]
        crc = [zlib.crc32(x) for x in ids]
        extra = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if with_ids else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(count), pa.array(crc, pa.int64()), *extra], names=names)


class _Place(InputPartition):
    def __init__(self, file: str, start: int):
        self.file, self.start = file, start


class TokenSource(DataSource):
    """``spark.read.format("token_shards").load(path)``, once registered: one partition for each shard.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers) and, with option ``ids`` = ``true``, the ids. Spark plans a Python source in six processes beside the
    driver, of about 200 MB in all; ``read_token_shards`` gives the same rows without them.
    """

    @classmethod
    def name(cls):
        return "token_shards"

    def schema(self):
        return _schema(self.options.get("ids") == "true")

    def reader(self, schema):
        return _TokenReader(self.options["path"], self.options.get("ids") == "true")


class _TokenReader(DataSourceReader):
    def __init__(self, path: str, with_ids: bool):
        self.path, self.with_ids, self.manifest = path, with_ids, _manifest(path)

    def partitions(self):
        return [_Place(s["file"], s["start"]) for s in self.manifest["shards"]] or [_Place("", 0)]

    def read(self, partition):
        if partition.file:
            yield from _shard_rows(self.path, self.manifest, partition.file, partition.start, self.with_ids)


def read_token_shards(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """The rows of ``TokenSource``, a task for each shard; the manifest is read once, here."""
    manifest = _manifest(path)
    places = [(s["file"], s["start"]) for s in manifest.pop("shards")]

    def read(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield from _shard_rows(path, manifest, *places[k], ids)

    return spark.range(0, len(places), 1, max(1, len(places))).mapInArrow(read, _schema(ids))
