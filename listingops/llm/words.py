"""Vectorised hashing of words and shingles over Arrow string columns, for use inside tasks.

A word is a run of bytes other than space and \\x09-\\x0D; A-Z are lower-cased. Hashes are 64-bit polynomials over
the bytes, computed by one cumulative sum per block, then mixed. Texts are taken whole; long ones go in blocks cut at
white space so that memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BLOCK = 1 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
with np.errstate(over="ignore"):
    VALUE = (np.random.Generator(np.random.PCG64(20240901)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1))[_LOWER]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse ** i for i < n, modulo 2 ** 64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 4096)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, b in (("up", BASE), ("down", inverse)):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = U(1)
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def hashes_of_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and the starts and ends of the words in data; no word crosses an offset."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~WHITE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(VALUE[data] * up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
    return mixed(h ^ (ends - starts).astype(np.uint64)), starts, ends


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def runs(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hashes, bounds): row first + r has the hashes bounds[r] : bounds[r + 1], in order."""
    data, offsets = buffers_of(column)
    for i, j in runs(offsets):
        low = offsets[i]
        part, off = data[low : offsets[j]], offsets[i : j + 1] - low
        if len(part) <= 2 * BLOCK:
            h, starts, _ = hashes_of_block(part, off)
            yield i, j, h, np.searchsorted(starts, off).astype(np.int64)
            continue
        h = hashes_of_long(part, np.array([0, len(part)]))[0]  # one long text
        yield i, j, h, np.array([0, len(h)], dtype=np.int64)


def hashes_of_long(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashes_of_block, in blocks of about BLOCK bytes that are cut at white space, so that memory stays bounded."""
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        if to < len(data):
            white = np.flatnonzero(WHITE[data[at:to]])
            while not len(white) and to < len(data):  # a word longer than a block
                to = min(len(data), to + BLOCK)
                white = np.flatnonzero(WHITE[data[at:to]])
            if to < len(data):
                to = at + int(white[-1]) + 1
        h, starts, ends = hashes_of_block(data[at:to], offsets[(offsets > at) & (offsets < to)] - at)
        found.append((h, starts + at, ends + at))
        at = to
    if not found:
        return hashes_of_block(data, offsets)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text in order; of all its words as one if it has fewer; none without words."""
    n = len(h)
    if not n:
        return h
    m, k = min(n, k), k
    with np.errstate(over="ignore"):
        x = np.full(n - m + 1, U(m), dtype=np.uint64)
        for d in range(m):
            x = x * BASE + h[d : n - m + 1 + d]
    return mixed(x)
