"""Words and word n-grams of whole texts as 64-bit hashes, computed on Arrow buffers.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, with A-Z
lower-cased. Non-ASCII characters are bytes of 0x80 and above in UTF-8, so the split can
be done on bytes. A batch is taken in pieces of about ``PIECE`` bytes of whole texts, which
bounds memory by the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.zeros(256, np.uint8)
for _low, _high, _shift in ((48, 57, 0), (65, 90, 32), (97, 122, 0), (128, 255, 0)):
    _LOWER[_low:_high + 1] = np.arange(_low, _high + 1) + _shift


def release() -> None:
    """Give freed memory back to the system: Python workers live on for later stages, beside the JVM of their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and the offsets of each text, without a copy of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(buf: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole texts of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


class Words:
    """The words of a piece: ``hash`` of each, ``first`` word and ``count`` of words of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = _LOWER[buf]
        inside = low != 0
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(buf)]
        fresh[begins] = inside[begins]
        at = np.flatnonzero(inside)
        new = fresh[at]
        first = np.flatnonzero(new)
        start = at[first]
        if len(at):
            where = at - start[np.cumsum(new) - 1]
            terms = _BYTE[low[at]] * powers(_ODD, int(where.max()) + 1)[where]
            self.hash = mix(np.add.reduceat(terms, first))
        else:
            self.hash = np.zeros(0, np.uint64)
        bounds = np.searchsorted(start, offsets)
        self.first, self.count = bounds[:-1], np.diff(bounds)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position of the first word) of every n-gram that lies inside one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        weight = powers(np.uint64(0xD1342543DE82EF95), n)
        total = self.hash[:m] * weight[0]
        for j in range(1, n):
            total += self.hash[j:m + j] * weight[j]
        left = np.repeat(self.first + self.count, self.count)[:m] - np.arange(m)
        at = np.flatnonzero(left >= n)
        return mix(total[at] + np.uint64(n)), at

    def short_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of the texts of fewer than n words, but not none: all their words as one gram."""
        docs = np.flatnonzero((self.count > 0) & (self.count < n))
        out = np.zeros(len(docs), np.uint64)
        for k in np.unique(self.count[docs]):
            rows = docs[self.count[docs] == k]
            weight = powers(np.uint64(0xD1342543DE82EF95), int(k))
            words = self.hash[self.first[rows][:, None] + np.arange(k)]
            out[self.count[docs] == k] = mix((words * weight).sum(1, dtype=np.uint64) + np.uint64(k))
        return out, docs


def batch_pieces(column) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of each piece of a text column."""
    buf, offsets = text_buffer(column)
    for i, j, part, own in pieces(buf, offsets):
        yield i, j, Words(part, own)
    release()
