"""Numpy helpers that read many texts at once: one byte array per chunk, polynomial fingerprints of any byte range in
constant time, words, and distinct word shingles. They run inside Arrow tasks; nothing here knows about Spark.

Fingerprints are 64 bits: two different ranges agree with a chance of about 2**-64 for each compared pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next chunk of the same task."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        p = np.full(max(n + 1, CHUNK_BYTES + 2), base, dtype=U)
        p[0] = 1
        _powers[base] = have = np.multiply.accumulate(p)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Prints:
    """Fingerprints of ranges of ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._down = _power(_INVERSE, n)
        self._sums = np.zeros(n + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * _power(_BASE, n)[:n], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def windows(self, width: int) -> np.ndarray:
        """Of every range of ``width`` bytes."""
        n = len(self._sums) - width
        if n <= 0:
            return np.empty(0, dtype=U)
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n])


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first row, last row, bytes, offsets).

    A text is never cut: one longer than the limit is a chunk of its own. Null counts as no bytes.
    """
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        wide = np.int32
    else:
        wide = np.int64
    if not len(col):
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=wide)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are no ASCII white space; runs stop at a row's end."""
    n = len(data)
    if not n:
        e = np.empty(0, dtype=np.int64)
        return e, e, e
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | first[:n]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


_TURNS = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, fingerprint) of the ``size``-word shingles, sorted. A-Z count as a-z; fewer words than ``size``
    make one shingle of all; no words make none. ``size`` is at most five."""
    low = _LOWER[data]
    start, end, row = word_bounds(low, offs)
    if not len(start):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=U)
    word = Prints(low)(start, end)
    m = max(len(word) - size + 1, 0)
    h = np.zeros(m, dtype=U)
    for i in range(size):
        h += word[i:i + m] * _TURNS[i]
    whole = row[:m] == row[size - 1:size - 1 + m]
    rows, prints = [row[:m][whole]], [mix(h[whole])]
    count = np.bincount(row, minlength=len(offs) - 1)
    first = np.cumsum(count) - count
    for few in range(1, size):
        r = np.flatnonzero(count == few)
        if len(r):
            h = np.full(len(r), few, dtype=U)
            for i in range(few):
                h += word[first[r] + i] * _TURNS[i]
            rows.append(r)
            prints.append(mix(h ^ U(0x5BD1E995)))
    row, h = np.concatenate(rows), np.concatenate(prints)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, in time that doesn't depend on ``width``."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])
