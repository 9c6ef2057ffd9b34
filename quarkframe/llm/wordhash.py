"""Words of whole Arrow string columns and 64-bit hashes of word sequences,
vectorised over many texts at a time.

A word is a maximal run of bytes other than space and \\t..\\r (in UTF-8 these
bytes occur only as themselves). A word's hash is a polynomial over its
bytes modulo 2^64, a sequence's hash a polynomial over its words' hashes;
both are differences of running sums, so that all windows of a text cost a
few array operations, whatever their length. A bit mixer finishes each hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20     # texts are taken so many bytes at a time (a longer text alone)
BYTE_FACTOR = 0x9E3779B97F4A7C15
WORD_FACTORS = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    """factor^0 .. factor^(n-1) modulo 2^64; kept for the next call."""
    if factor not in _POWERS or len(_POWERS[factor]) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=np.uint64)
        if size > 4 * SLICE_BYTES:
            return table
        _POWERS[factor] = table
    return _POWERS[factor]


def _inverse(factor: int) -> int:
    return pow(factor, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Consecutive rows of a column: first row, number of rows, the words'
    hashes, rows (within the slice), byte ranges, and words per row."""

    first: int
    rows: int
    hashes: np.ndarray
    row: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    data: np.ndarray

    def bounds(self) -> np.ndarray:
        """Row i's words are bounds[i]..bounds[i+1]."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def scan(texts: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """The words of a string column, slice by slice; ``lower`` lower-cases A-Z."""
    off, raw = column_bytes(texts)
    a, total = 0, len(off) - 1
    while a < total:
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, side="right")) - 1)
        yield _slice(a, b, off[a:b + 1] - off[a], raw[off[a]:off[b]], lower)
        a = b


def _slice(a: int, b: int, rel: np.ndarray, data: np.ndarray, lower: bool) -> Slice:
    n = len(data)
    if lower:
        data = _LOWER[data]
    sep = _SEPARATOR[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = sep[:-1], sep[1:]
    full = rel[1:] > rel[:-1]
    before[rel[:-1][full]] = True
    after[rel[1:][full] - 1] = True
    starts = np.flatnonzero(~sep & before)
    ends = np.flatnonzero(~sep & after) + 1
    row = np.searchsorted(rel, starts, side="right") - 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BYTE_FACTOR, n)[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _powers(_inverse(BYTE_FACTOR), n)[starts])
    return Slice(a, b - a, h, row, starts, ends, np.bincount(row, minlength=b - a), data)


def sequence_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of words[first[i]:last[i]] for each i. ``which`` (0 or 1) picks
    one of two independent hashes."""
    factor, n = WORD_FACTORS[which], len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(factor, n)[:n], out=sums[1:])
    h = (sums[last] - sums[first]) * _powers(_inverse(factor), n + 1)[first]
    return mix(h + (last - first).astype(np.uint64))


def window_starts(s: Slice, length: int) -> np.ndarray:
    """Where the windows of ``length`` words that lie in one row start."""
    n = len(s.hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(s.row[:n] == s.row[length - 1:])
