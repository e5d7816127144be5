"""Vectorised word and shingle hashing over the character buffers of Arrow batches.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.  A chunk of documents is one
byte buffer with offsets; all hashing is numpy over that buffer, so there is no Python work per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240817))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = _rng.integers(1, 1 << 63, 8, dtype=U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(21, int(n).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[U(1), np.full(size - 1, b, U)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; null is empty."""
    text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _hash_span(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each document the number of words before it (one more entry)."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):  # a long text goes in spans of whole words, so that memory stays bounded
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        at = starts[a]
        out[a:b] = _hash_span(data[at : ends[b - 1]], starts[a:b] - at, ends[a:b] - at)
        a = b
    return out, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, and their bounds (one more than documents).

    A document with fewer words than ``width`` has its whole word sequence as its one shingle; without words none.
    """
    word, before = words(data, offsets)
    count = np.diff(before)
    many = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    bound = np.r_[0, np.cumsum(many)]
    if not bound[-1]:
        return np.zeros(0, U), bound
    at = np.repeat(before[:-1] - bound[:-1], many) + np.arange(bound[-1])
    out = np.zeros(len(at), U)
    for j in range(width):
        out += word[np.minimum(at + j, len(word) - 1)] * _STEP[j]
    salt = np.arange(width, dtype=U) * _STEP[7]
    for d in np.flatnonzero((count > 0) & (count < width)):
        out[bound[d]] = np.sum(word[before[d] : before[d + 1]] * _STEP[: count[d]], dtype=U) ^ salt[count[d]]
    out = mix(out)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    inner = bound[1:-1]
    keep[inner[inner < len(out)]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][bound]


def sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of each document's values."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[bound[1:]] - total[bound[:-1]]
