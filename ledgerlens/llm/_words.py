"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. Texts are
handled in chunks of whole documents, so memory follows the chunk (or the
longest single document), not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_K = _U(0x9E3779B97F4A7C15)
_KINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _K)

def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. Not kept between calls: a task's
    globals are freed late, and these arrays are as long as the chunk."""
    out = []
    for base in (_K, _KINV):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, out=p))
    return out[0], out[1]


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that hold about
    ``limit`` bytes; NULL is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("") if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else col.fill_null(b"")
    if not len(col):
        return
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, len(col))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and document (row within the chunk) of every word, in order."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~IS_SPACE[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offs[:-1][(offs[:-1] < n) & (offs[1:] > offs[:-1])]
    start[first] = inside[first]
    end = np.empty(n, bool)
    end[:-1] = inside[:-1] & (~inside[1:] | start[1:])
    end[-1] = inside[-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _pow(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[LOWER[buf] if lower else buf] * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(offs, s, "right") - 1


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of one chunk, by their bytes alone."""
    up, down = _pow(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``n`` words of one document."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(h) - n + 1
    g = h[:size].copy()
    for k in range(1, n):
        g = mix(g * _K + h[k : k + size])
    ok = doc[:size] == doc[n - 1 :]
    return g[ok], doc[:size][ok]


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, its length included."""
    g = np.array([len(h)], np.uint64)
    for x in h:
        g = mix(g * _K + x + _U(0xA5A5A5A5))
    return g[0]
