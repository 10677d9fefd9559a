"""Vectorised word kernels over Arrow text columns.

Words are runs of bytes of one class. Both classes that the operators use (ASCII separators against everything
else; ASCII letters, digits and all non-ASCII against the rest) are decided byte by byte in UTF-8, so whole columns
are cut into words and hashed by numpy without making a Python string for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one step of a kernel handles; its temporaries are about 30 times this.
STEP = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
_POW = np.empty(STEP, U64)
_INV = np.empty(STEP, U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW[0] = _INV[0] = 1
with np.errstate(over="ignore"):
    _inv = pow(_BASE, -1, 1 << 64)
    _filled = 1
    while _filled < STEP:  # powers by doubling
        m = min(_filled, STEP - _filled)
        _POW[_filled : _filled + m] = _POW[:m] * U64(pow(_BASE, _filled, 1 << 64))
        _INV[_filled : _filled + m] = _INV[:m] * U64(pow(_inv, _filled, 1 << 64))
        _filled += m


class WordClass:
    """Which bytes belong to words, and a 64-bit value for each; A-Z count as a-z when ``lower``."""

    def __init__(self, separators: bytes, lower: bool):
        self.is_word = np.ones(256, bool)
        self.is_word[np.frombuffer(separators, np.uint8)] = False
        values = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        if lower:
            values[65:91] = values[97:123]
        self.values = np.where(self.is_word, values, U64(0))


def _bytes(*ranges: tuple[int, int]) -> bytes:
    return bytes(b for lo, hi in ranges for b in range(lo, hi + 1))


#: Words ``[^\x20\x09-\x0D]+``, lower-cased in A-Z.
SPACED = WordClass(_bytes((0x20, 0x20), (0x09, 0x0D)), lower=True)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: A-Z therefore are word bytes.
PLAIN = WordClass(_bytes((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)), lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, shift = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, n + 1 + shift)[shift:]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last)[first:] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def blocks(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most ``most`` bytes, or of one longer row."""
    raw, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, kind: WordClass) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the n + 1 positions at which each row's words begin.

    A word longer than one step is hashed in pieces that are combined, so memory stays bounded for any text.
    """
    hashes, starts = [], []
    size, at = len(raw), 0
    carry: list[tuple[int, int, int]] = []  # an open word: start, sum so far, length so far
    breaks = np.unique(offsets)
    while at < size:
        end = min(at + STEP, size)
        piece = raw[at:end]
        is_word = kind.is_word[piece]
        open_before = np.empty(len(piece), bool)
        open_before[1:] = is_word[:-1]
        open_before[0] = bool(carry)
        lo, hi = np.searchsorted(breaks, (at, end))
        open_before[breaks[lo:hi] - at] = False
        begin = np.flatnonzero(is_word & ~open_before)
        with np.errstate(over="ignore"):
            value = kind.values[piece] * _POW[: len(piece)]
            if carry:  # what belongs to the word that was open at the cut
                stop = int(begin[0]) if len(begin) else len(piece)
                start, total, length = carry.pop()
                inside = is_word[:stop] if open_before[0] else is_word[:0]
                more = int(np.argmin(inside)) if len(inside) and not inside.all() else len(inside)
                total = (total + int(value[:more].sum(dtype=U64)) * pow(_BASE, length, 1 << 64)) % (1 << 64)
                length += more
                if more == len(piece) and end < size and end not in breaks[hi : hi + 1]:
                    carry.append((start, total, length))
                else:
                    hashes.append(np.array([total], U64))
                    starts.append(np.array([start], np.int64))
            if len(begin):
                sums = np.add.reduceat(value, begin) * _INV[begin]
                if is_word[-1] and end < size and end not in breaks[hi : hi + 1]:
                    carry.append((at + int(begin[-1]), int(sums[-1]), len(piece) - int(begin[-1])))
                    sums, begin = sums[:-1], begin[:-1]
                hashes.append(sums)
                starts.append(begin + at)
        at = end
    if carry:
        hashes.append(np.array([carry[0][1]], U64))
        starts.append(np.array([carry[0][0]], np.int64))
    h = mix(np.concatenate(hashes)) if hashes else np.zeros(0, U64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive words beginning at each position (the last width - 1 ones are not used)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = h[:n].copy()
        for k in range(1, width):
            total *= U64(0xD6E8FEB86659FD93)
            total += h[k : k + n]
    return mix(total)
