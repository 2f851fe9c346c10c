"""Vectorised word tables over Arrow string buffers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never
occur inside a multi-byte UTF-8 sequence, so cutting bytes equals cutting code
points.  Hashes are 64 bits: a polynomial over random byte values, finished by
a mixing step.  They are the same in every process, batch and run.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_U = np.uint64
try:
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-8, 1)  # one heap for all threads
    _libc.mallopt(-3, 4 << 20)  # arrays from 4 MB on go back to the system when they are freed
    _trim = _libc.malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None
WS = np.zeros(256, bool)
WS[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_T = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_TLOW = _T.copy()
_TLOW[65:91] = _T[97:123]
_P = _U(0x9E3779B97F4A7C15 | 5)
_PINV = _U(pow(int(_P), -1, 1 << 64))
_Q = _U(0xD6E8FEB86659FD93)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        if n > 2 * CHUNK_BYTES:  # one very long text: not kept
            return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p)])) for p in (_P, _PINV))
        n = max(n, CHUNK_BYTES + (64 << 10))
        _pow, _ipow = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p)])) for p in (_P, _PINV))
    return _pow, _ipow


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that no bits of ``h`` are lost."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: What a worker keeps from task to task.
KEPT: dict = {}


def release(keep: bool = False) -> None:
    """Give freed memory back to the system; Spark's Python workers live on from task to task.  ``keep``: but not what is kept from task to task."""
    if not keep:
        KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each; ``keep`` as for :func:`release`."""
    release(keep)  # what the task before has left
    for b in batches:
        if not b.num_rows:
            continue
        ends = text_buffer(b.column(b.schema.get_field_index(column)))[1][1:]
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to
        del b, ends
    release(keep)


class Words:
    """Words of a chunk: byte ``start``/``end``, hash ``h``, and per document the bounds ``lo``/``hi`` into those arrays."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False, hashed: bool = True):
        n = len(buf)
        self.buf, self.offs = buf, offs
        solid = np.zeros(n + 2, bool)
        np.logical_not(WS[buf], out=solid[1:-1])
        body = solid[1:-1]
        first = np.zeros(n + 1, bool)
        first[offs] = True  # a word ends where its document does
        self.start = np.flatnonzero(body & (~solid[:-2] | first[:-1]))
        self.end = np.flatnonzero(body & (~solid[2:] | first[1:])) + 1
        bounds = np.searchsorted(self.start, offs)
        self.lo, self.hi = bounds[:-1], bounds[1:]
        if hashed:
            self.h = span_hash(buf, self.start, self.end, lower)

    @property
    def counts(self) -> np.ndarray:
        return self.hi - self.lo

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lo)), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all n-grams within one document, and their hashes."""
        return gram_hash(self.h, self.lo, self.hi, n)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    p, q = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    v = (_TLOW if lower else _T)[buf]
    v *= p[: len(buf)]
    np.cumsum(v, out=acc[1:])
    h = acc[end] - acc[start]
    h *= q[start]
    h ^= (end - start).astype(np.uint64) * _Q
    return mix(h)


def gram_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - n + 1
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= _Q
        acc += h[j : j + m]
    limit = np.repeat(hi, hi - lo)[:m]
    at = np.flatnonzero(np.arange(m) + n <= limit)
    return at, mix(acc[at] + _U(n))
