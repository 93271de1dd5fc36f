"""Byte-level numpy kernels over Arrow string columns.

A column's UTF-8 bytes are used in place; work goes on in slices of a few megabytes, so memory follows the slice and the
longest single text, never the batch. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 3 << 19

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_M64 = (1 << 64) - 1
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, SLICE + 1)
        p = np.full(n, _MULT, dtype=np.uint64)
        q = np.full(n, _INV, dtype=np.uint64)
        p[0] = q[0] = 1
        _pow, _inv = np.cumprod(p), np.cumprod(q)
    return _pow, _inv


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a run passes `limit` bytes only for a single text."""
    data, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one separator byte (a space) after each, and the new offsets; text i ends at offsets[i+1] - 1."""
    n = len(off) - 1
    new = off + np.arange(n + 1)
    out = np.full(len(data) + n, 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(off))] = data
    return out, new


#: The white space of word splitting, \x20 and \x09-\x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        edge = np.concatenate(([0], edge))
    if mask[-1]:
        edge = np.concatenate((edge, [len(mask)]))
    return edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: polynomial over prefix sums, then mixed with the length."""
    p, q = _powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=pre[1:])
    return mix((pre[end] - pre[start]) * q[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def reduce_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, dtype=None) -> np.ndarray:
    """Sums over consecutive groups, 0 for the empty ones."""
    out = np.zeros((len(starts), *values.shape[1:]), dtype=dtype or values.dtype)
    full = np.flatnonzero(ends > starts)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=dtype)
    return out


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i] + count[i] - 1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) + np.repeat(start - first, count)


def _ends_word() -> tuple[np.ndarray, np.ndarray]:
    lead2 = np.zeros(256, dtype=bool)
    lead2[0xC3:0xE0] = True
    lead3 = np.zeros(256, dtype=bool)
    lead3[[0xE0, *range(0xE4, 0xF0)]] = True
    return lead2, lead3


_LEAD2, _LEAD3 = _ends_word()


def chunk_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of a space or line feed right after a character that is surely no white space: printable ASCII, or a
    two- or three-byte character from a range of UTF-8 lead bytes without Unicode white space."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(((data == 32) | (data == 10))[1:]) + 1
    b1 = data[at - 1]
    ok = (b1 > 32) & (b1 < 127)
    b2 = data[np.maximum(at - 2, 0)]
    b3 = data[np.maximum(at - 3, 0)]
    high = b1 >= 128
    ok |= high & (at >= 2) & _LEAD2[b2]
    ok |= high & (at >= 3) & (b2 >= 128) & (b2 < 192) & _LEAD3[b3]
    return at[ok]
