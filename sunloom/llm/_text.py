"""Vectorised word hashing over Arrow string buffers (no per-word Python).

A word is a maximal run of ASCII letters, digits and non-ASCII bytes; ASCII
letters are lower-cased.  A word's 64-bit hash is a polynomial over its bytes,
read off one prefix sum for a whole batch, then mixed.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_tables: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]

#: Bytes of text that are hashed at once; a longer document is a block by itself.
BLOCK = 1 << 20


def given_back() -> None:
    """Gives memory that is free in this process back to the system: allocators keep it, and an idle worker would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run over the batches of a part; what it has freed goes back to the system when the part is done."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch], *args) -> Iterator[pa.RecordBatch]:
        yield from run(batches, *args)
        given_back()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of the 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_tables[0]) < n:
        size = max(n, BLOCK)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _tables[k] = np.cumprod(steps, dtype=np.uint64)
    return _tables[0], _tables[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def blocks(raw: np.ndarray, offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `size` bytes."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and the rows' offsets into them."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = WORD[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offs[:-1][offs[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offs[1:][offs[1:] > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return starts, ends, mix(h), np.searchsorted(starts, offs)


def grams(h: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles and the rows' offsets into them; a shorter, non-empty row is one shingle of all its words."""
    count = np.diff(offs)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_offs = np.concatenate(([0], np.cumsum(own)))
    row = np.repeat(np.arange(len(count)), own)
    at = offs[:-1][row] + (np.arange(out_offs[-1]) - out_offs[:-1][row])
    g = np.zeros(len(at), np.uint64)
    length = np.minimum(count[row], n)
    last = max(len(h) - 1, 0)
    for k in range(n):
        nxt = mix(g * np.uint64(_BASE) + h[np.minimum(at + k, last)] + np.uint64(k + 1)) if len(h) else g
        g = nxt if not (length <= k).any() else np.where(k < length, nxt, g)
    return g, out_offs
