"""Vectorised text kernels over Arrow string columns (numpy, no per-word Python).

A chunk of texts is viewed as one byte buffer; words are maximal runs of bytes
other than ``\\x20`` and ``\\x09-\\x0D``; A-Z is folded to a-z before hashing.
Null texts behave as empty ones.  All hashes are 64 bit and the same on every
machine, so two passes over the same text agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9FB21C651E98DF25)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def release() -> None:
    """Give freed memory back: workers stay alive between tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def releasing(run: Callable) -> Callable:
    """A generator over batches that gives freed memory back when it ends."""

    @wraps(run)
    def wrapped(*args) -> Iterator[pa.RecordBatch]:
        yield from run(*args)
        release()

    return wrapped


class Words(NamedTuple):
    """Words of a chunk: hash, row of the chunk, byte start and end (exclusive)."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    rows: int


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + 1)
        back = pow(_BASE, -1, 1 << 64)
        _pow = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, dtype=np.uint64)]), dtype=np.uint64)
        _inv = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back, dtype=np.uint64)]), dtype=np.uint64)
    return _pow, _inv


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row offset, byte offsets (rows + 1) and bytes of runs of rows of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, offs[at : to + 1] - offs[at], data[offs[at] : offs[to]]
        at = to


def words(offs: np.ndarray, raw: np.ndarray) -> Words:
    n, rows = len(raw), len(offs) - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, none, raw, rows)
    data = _FOLD[raw]
    isw = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    start = isw.copy()
    start[1:] &= ~isw[:-1] | first[1:n]
    end = isw.copy()
    end[:-1] &= ~isw[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    p, inv = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    h = fmix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
    row = np.searchsorted(offs, s, side="right") - 1
    return Words(h, row, s, e, data, rows)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``size``-word shingle, with repeats; fewer words than ``size`` give the whole sequence as one."""
    n = len(w.hash)
    counts = np.bincount(w.row, minlength=w.rows) if n else np.zeros(w.rows, dtype=np.int64)
    parts_h, parts_r = [], []
    if n >= size:
        ok = w.row[: n - size + 1] == w.row[size - 1 :]
        h = w.hash[: n - size + 1]
        for k in range(1, size):
            h = h * _STEP + w.hash[k : n - size + 1 + k]
        parts_h.append(fmix(h[ok]))
        parts_r.append(w.row[: n - size + 1][ok])
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    for few in range(1, size):
        rows = np.flatnonzero(counts == few)
        if len(rows):
            h = w.hash[begin[rows]]
            for k in range(1, few):
                h = h * _STEP + w.hash[begin[rows] + k]
            parts_h.append(fmix(h + np.full(1, few, dtype=np.uint64) * _MIX))
            parts_r.append(rows)
    if not parts_h:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(parts_h), np.concatenate(parts_r)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then hash."""
    if not len(h):
        return h, row
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Wrapping sum of ``values`` by row (rows ascending)."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    bound = np.searchsorted(row, np.arange(rows + 1))
    return total[bound[1:]] - total[bound[:-1]]
