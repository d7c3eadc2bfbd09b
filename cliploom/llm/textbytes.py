"""Whole Arrow batches of texts as one byte array: words, n-grams and substring hashes.

A batch of texts is the concatenation of their UTF-8 bytes plus one offset per text, as Arrow
stores it. Everything here works on such arrays, so cost per text is a few array
operations and memory is proportional to the bytes of one block. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

# Texts are taken in blocks of about this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = {int(b): np.uint64(pow(int(b), -1, 1 << 64)) for b in (_BASE, _SECOND_BASE)}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of each 64-bit value over all its bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true in the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_SPACE = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
ALPHANUMERIC = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # after lower-casing


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string or binary array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) of consecutive blocks."""
    data, at = flat(texts)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of maximal runs of bytes in ``table``; none crosses texts."""
    inside = table[data]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    before[edges] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


@cache
def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _powers_for(base: np.uint64, size: int) -> np.ndarray:
    usual = BLOCK_BYTES + (1 << 17)
    if size > usual:  # a block of one long text; workers keep the usual table only
        return _powers.__wrapped__(int(base), size)
    return _powers(int(base), usual)


class Substrings:
    """Hashes of any substrings of a block, after one pass over its bytes."""

    def __init__(self, data: np.ndarray, second: bool = False):
        base = _SECOND_BASE if second else _BASE
        n = len(data)
        terms = _BYTE_VALUES[data]
        terms *= _powers_for(base, max(n, 1))[:n]
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, out=self._sums[1:])
        self._undo = _powers_for(_INVERSE[int(base)], n + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each substring; equal bytes have equal hashes wherever they stand."""
        found = self._sums[ends] - self._sums[starts]
        found *= self._undo[starts]
        return mix(found + (ends - starts).astype(np.uint64))

    def hash_all(self, length: int) -> np.ndarray:
        """Hash of the substring of this length at each start that has one."""
        n = len(self._sums) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        found = self._sums[length:] - self._sums[:n]
        found *= self._undo[:n]
        return mix(found + np.uint64(length))


def ngrams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n consecutive values of one owner, and the position of its first."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:m].copy()
    for k in range(1, n):
        total *= _BASE
        total += hashes[k : k + m]
    first = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return mix(total[first] + np.uint64(n)), first


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.r_[0, cuts], np.r_[cuts, len(values)]


def merge_spans(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans of each owner as maximal, disjoint spans; touching spans join."""
    if not len(starts):
        return owner, starts, ends
    order = np.lexsort((starts, owner))
    owner, starts, ends = owner[order], starts[order], ends[order]
    _, group = np.unique(owner, return_inverse=True)
    stride = int(ends.max()) + 2  # owners apart from each other on one axis
    low, high = starts + group * stride, np.maximum.accumulate(ends + group * stride)
    first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    last = np.r_[first[1:], len(low)] - 1
    return owner[first], starts[first], high[last] - group[first] * stride
