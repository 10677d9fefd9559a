"""Benchmark decontamination by suffix arrays over the training words.

Every task cuts its documents into words (hashed by the column kernels), builds a suffix array over each run of at most
``SEGMENT`` words, and binary-searches every benchmark suffix in it at once. The array orders suffixes by 16-bit word
codes, four to a machine word, deepened by prefix doubling until the longest benchmark suffix is settled; matches are
then confirmed on the 64-bit word hashes. Documents move nowhere: the only thing sent out is the benchmark, in slices of
at most ``SLICE_BYTES`` of text, each one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import PLAIN, U64, blocks, mix, words

SEGMENT = 1 << 19
SLICE_BYTES = 16 << 20


def _packed(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the codes of four words from it on, first in the top bits; 0 beyond the document's end.

    ``ends``: for each position, the position after its document's last word.
    """
    n = len(code)
    out = np.zeros(n, U64)
    place = np.arange(n)
    for k in range(4):
        shifted = np.zeros(n, U64)
        shifted[: max(0, n - k)] = code[k:]
        shifted[place + k >= ends] = 0
        out |= shifted << U64(48 - 16 * k)
    return out


def suffix_array(packed: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the codes from them on, settled for the first ``depth`` words at least."""
    order = np.argsort(packed, kind="stable")
    keys = packed[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    rank = np.empty(len(order), np.int64)
    h = 4
    while h < depth and not head.all():
        group = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))  # first place of each group
        rank[order] = group + 1
        tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))
        at = order[tied]
        nxt = np.zeros(len(at), np.int64)
        inside = at + h < ends[at]
        nxt[inside] = rank[at[inside] + h]
        by = np.lexsort((nxt, group[tied]))
        order[tied] = at[by]
        fresh, same = nxt[by], group[tied][by]
        head[tied] = np.concatenate([[True], (fresh[1:] != fresh[:-1]) | (same[1:] != same[:-1])])
        h *= 2
    return order


def _search(order, packed, ends, lo, hi, at, value, mask):
    """Narrow each interval [lo, hi) of the array to the suffixes whose packed codes ``at`` words on are ``value``."""

    def bound(lo, hi, after):
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            pos = order[np.minimum(mid, len(order) - 1)] + at
            own = order[np.minimum(mid, len(order) - 1)]
            got = np.where(pos < ends[own], packed[np.minimum(pos, len(packed) - 1)], U64(0)) & mask
            right = open_ & ((got <= value) if after else (got < value))
            lo = np.where(right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    first = bound(lo, hi, False)
    return first, bound(first, hi, True)


class Benchmark:
    """The words of benchmark items, and every distinct window of ``width`` of them (shorter items: the whole item).

    ``start`` and ``length`` place a distinct window in the words; ``of`` to ``of`` + 1 in ``first`` are the items that hold it (``item``)
    and its first place in each (``at``).
    """

    def __init__(self, ids: list, texts: list, width: int):
        ids, texts = (list(x) for x in zip(*sorted(zip(ids, texts, strict=True), key=lambda x: (str(x[0]), x[1] or "")), strict=True)) if ids else ([], [])
        hashes, at, base = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
        for _, _, raw, offsets in blocks(pa.array(texts, pa.large_string())):
            h, to = words(raw, offsets, PLAIN)
            hashes.append(h)
            at.append(to[1:] + base)
            base += len(h)
        self.h, to = np.concatenate(hashes), np.concatenate(at)
        self.code = (self.h >> U64(48)) | U64(1)
        count = np.diff(to)
        n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        item = np.repeat(np.arange(len(count)), n)
        start = np.concatenate([np.arange(a, a + k) for a, k in zip(to[:-1], n, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        length = np.minimum(count, width)[item]
        key = length.astype(U64)
        for k in range(width):  # one value for each content
            more = mix(key * U64(0x9E3779B97F4A7C15) + self.h[np.minimum(start + k, max(0, len(self.h) - 1))])
            key = np.where(k < length, more, key)
        _, chosen, of = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.length = start[chosen], length[chosen]
        by = np.lexsort((start, item, of))
        of, item, start = of[by], item[by], start[by]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (item[1:] != item[:-1])]) if len(of) else np.zeros(0, bool)
        self.item, self.at = item[new], (start - to[item])[new]
        self.first = np.searchsorted(of[new], np.arange(len(chosen) + 1))
        self.names = ids
        self.longest = int(count.max(initial=0))
        self.packed = _packed(self.code, np.repeat(to[1:], count))


def _matches(h: np.ndarray, ends: np.ndarray, bench: Benchmark, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of every distinct window in one segment of words.

    At a position at most one window of each length can occur, so the result is bounded by the segment.
    """
    none = np.zeros(0, np.int64)
    if not len(h) or not len(bench.start):
        return none, none
    code = (h >> U64(48)) | U64(1)
    packed = _packed(code, ends)
    order = suffix_array(packed, ends, max(bench.longest, width))
    window = np.arange(len(bench.start))
    lo, hi = np.zeros(len(window), np.int64), np.full(len(window), len(order), np.int64)
    for level in range(0, width, 4):
        want = np.clip(bench.length[window] - level, 0, 4)
        going = want > 0
        mask = np.where(want == 4, ~U64(0), ~(~U64(0) >> (U64(16) * want.astype(U64) % U64(64))))
        pos = np.minimum(bench.start[window] + level, len(bench.packed) - 1)
        value = bench.packed[pos] & mask
        first, last = _search(order, packed, ends, lo, hi, level, value, mask)
        lo, hi = np.where(going, first, lo), np.where(going, last, hi)
        found = lo < hi
        window, lo, hi = window[found], lo[found], hi[found]
        if not len(window):
            return none, none
    many = hi - lo
    which = np.repeat(window, many)
    place = order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    good = place + bench.length[which] <= ends[place]
    which, place = which[good], place[good]
    for k in range(width):  # codes are short; the hashes decide
        inside = k < bench.length[which]
        good = ~inside | (h[np.minimum(place + k, len(h) - 1)] == bench.h[np.minimum(bench.start[which] + k, len(bench.h) - 1)])
        which, place = which[good], place[good]
    return place, which


def _runs(row, place, which, bench):
    """Longest verbatim matches (row, item, place, place in the item, words).

    Windows that follow each other in a document and in an item make one match. Where a document repeats one
    window at places in a row (the same words again and again), those are taken together first, so equal words cost no product.
    """
    by = np.lexsort((place, which, row))
    row, place, which = row[by], place[by], which[by]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (which[1:] != which[:-1]) | (place[1:] > place[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    row, which, begin, end = row[first], which[first], place[first], place[last]
    held = bench.first[which + 1] - bench.first[which]
    nth = np.repeat(bench.first[which], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    row, which, begin, end = (np.repeat(x, held) for x in (row, which, begin, end))
    item, at = bench.item[nth], bench.at[nth]
    diagonal = begin - at
    by = np.lexsort((begin, diagonal, item, row))
    row, item, diagonal, begin, end, at, length = (x[by] for x in (row, item, diagonal, begin, end, at, bench.length[which]))
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (begin[1:] > end[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    return row[first], item[first], begin[first], at[first], end[last] + length[last] - begin[first]


def _hits(bench: Benchmark, width: int, column):
    """(first row, n, word counts, hit words, row, place, window of each occurrence) of blocks of rows."""
    for i, j, raw, offsets in blocks(column):
        h, at = words(raw, offsets, PLAIN)
        n = j - i
        ends = np.repeat(at[1:], np.diff(at))
        places, windows_ = [], []
        for a in range(0, max(1, len(h)), SEGMENT):
            b = min(len(h), a + SEGMENT + width - 1)  # a window that runs over the cut is found here
            p, w = _matches(h[a:b], np.minimum(ends[a:b], b) - a, bench, width)
            places.append(p + a)
            windows_.append(w)
        place, which = np.concatenate(places), np.concatenate(windows_)
        size = len(h) + 1
        hit = np.bincount(place, minlength=size) - np.bincount(place + bench.length[which], minlength=size)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
        row = np.searchsorted(at, place, "right") - 1
        yield i, n, at, covered[at[1:]] - covered[at[:-1]], row, place, which


def _scan(bench: Benchmark, width: int, id_col: str, text_col: str):
    def run(batches):
        for batch in batches:
            ids = batch.column(id_col)
            for i, n, at, n_hit, row, place, which in _hits(bench, width, batch.column(text_col)):
                items: list[list] = [[] for _ in range(n)]
                runs: list[list] = [[] for _ in range(n)]
                if len(place):
                    for r, x, p, q, length in zip(*(v.tolist() for v in _runs(row, place, which, bench)), strict=True):
                        name = None if bench.names[x] is None else str(bench.names[x])
                        if name is not None:
                            items[r].append(name)
                        runs[r].append({"item": name, "doc_word": p - int(at[r]), "item_word": q, "words": length})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n).cast(pa.int64()), pa.array(np.diff(at)), pa.array(n_hit), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(runs, _RUNS)],
                    names=["id", "n_words", "n_hit", "items", "matches"],
                )

    return run


def _clean(bench: Benchmark, width: int, text_col: str):
    def run(batches):
        for batch in batches:
            keep = [n_hit == 0 for _, _, _, n_hit, *_ in _hits(bench, width, batch.column(text_col))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return run


_RUNS = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))
_SCHEMA = "id long, n_words long, n_hit long, items array<string>, matches array<struct<item:string,doc_word:long,item_word:long,words:long>>"


def _slices(items: DataFrame, item_col: str, item_text: str, width: int) -> Iterator[Benchmark]:
    """The items, in slices of bounded size."""
    cols = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    total = cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = int(total // SLICE_BYTES) + 1
    for k in range(slices):
        rows = (cols.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k) if slices > 1 else cols).collect()
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows], width)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs; a pass over the texts for each slice of items."""
    for bench in _slices(items, item_col, item_text, width):
        docs = docs.mapInArrow(_clean(bench, width, text_col), docs.schema)
    return docs


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``n_words``, ``n_hit``, ``items`` (sorted), ``matches``.

    ``n_hit`` counts the document's words inside any occurrence of a window of ``width`` consecutive words of an item
    (an item of fewer words, but not none, is one window). ``matches`` lists the longest verbatim matches with their
    places. Null and empty texts have no words and match nothing; items without words match nothing; an item whose id is null
    contributes hits but is not listed; equal ids and repeated rows are judged row by row. Items are sent out in slices of
    bounded size; if there are several, each row's results are merged by the row's position in a written table.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slices = list(_slices(items, item_col, item_text, width))
    if len(slices) == 1:
        return base.mapInArrow(_scan(slices[0], width, "id", "text"), _SCHEMA)
    store = Scratch(docs.sparkSession, "decontam")
    base = store.keep(base.withColumn("row", F.monotonically_increasing_id()), "docs")
    parts = [base.select(F.col("row").alias("id"), "text").mapInArrow(_scan(bench, width, "id", "text"), _SCHEMA) for bench in slices]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.union(part)
    span = F.expr("flatten(transform(matches, m -> sequence(m.doc_word, m.doc_word + m.words - 1)))")
    merged = merged.select("id", "n_words", "items", "matches", span.alias("hit"))
    merged = merged.groupBy("id").agg(F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches"))
    return merged.join(base.select(F.col("row").alias("id"), F.col("id").alias("doc")), "id").select(F.col("doc").alias("id"), "n_words", "n_hit", "items", "matches")
