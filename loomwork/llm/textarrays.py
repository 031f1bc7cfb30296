"""Vectorised tokenising of Arrow string columns.

Texts stay one UTF-8 byte buffer; words, lines and their 64-bit hashes are numpy
arrays over that buffer, so no Python string is made for each word.  Words are
maximal runs of bytes other than space and 0x09-0x0D (never part of a multi-byte
UTF-8 character).  A null text counts as an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """Word spans [start, end) in bytes of a buffer, the first word of each text, and hashes."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1 indices into start
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _byte_values(lower: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER) | np.uint64(1)
    return values[_LOWER] if lower else values


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for n positions."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_MULTIPLIER, inverse)]
    return _powers[0], _powers[1]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each, the first being 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = buffer_of(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _prefix(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def segment_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE) -> Words:
    """The words of each text; with lower, A-Z count as a-z in the hashes. breaks: the bytes between words."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    word = ~breaks[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums, inverse = _prefix(data, lower)
    return Words(start, end, np.searchsorted(start, offsets), segment_hash(sums, inverse, start, end))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The \\n-split lines of each text, the empty ones too (n breaks make n + 1 lines)."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    per_text = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    if n == 0:
        return Words(start, end, first, np.zeros(len(start), np.uint64))
    sums, inverse = _prefix(data, False)
    return Words(start, end, first, segment_hash(sums, inverse, start, end))


def window_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each run of n words; len(hashes) - n + 1 values, texts not kept apart."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= _MULTIPLIER
        out += hashes[k : k + size]
    return mix(out)


def text_of(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def hashes_of(words: list[str], lower: bool = True) -> np.ndarray:
    """The hashes that words_of and segment_hash give to these words."""
    parts = [w.encode() for w in words]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([0, *map(len, parts)])
    sums, inverse = _prefix(data, lower)
    return segment_hash(sums, inverse, ends[:-1], ends[1:])
