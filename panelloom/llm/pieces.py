"""Encoding by distinct chunks: texts are cut at positions where no token can cross, each distinct chunk is encoded once a
worker, and the ids of whole texts are gathered from those of their chunks.

A 64-bit hash finds a chunk in the store, and its bytes decide: a chunk whose bytes differ from those kept under its hash is
encoded by itself. The store is emptied when it has over `MOST` chunks or `MOST_BYTES` of them, so memory is bounded whatever
the vocabulary of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import _text as T

MOST = 800_000
MOST_BYTES = 64 << 20


def _room(held: np.ndarray, need: int) -> np.ndarray:
    """`held`, or a copy with room for `need` values."""
    if need <= len(held):
        return held
    out = np.zeros(max(need, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


LONG = 256


def differing(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` bytes at x_start in x and at y_start in y differ, eight bytes at a time. Both x and y go on for
    seven bytes after their last span at least."""
    wx, wy = (np.ndarray((len(v) - 7,), dtype="<u8", buffer=v, strides=(1,)) for v in (x, y))
    out = np.zeros(len(size), dtype=bool)
    for k in np.flatnonzero(size > LONG).tolist():
        a, b, n = int(x_start[k]), int(y_start[k]), int(size[k])
        out[k] = not np.array_equal(x[a : a + n], y[b : b + n])
    on, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(on):
        left = size[on] - at
        d = wx[x_start[on] + at] ^ wy[y_start[on] + at]
        short = left < 8
        d[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[on[d != 0]] = True
        on, at = on[left > 8], at + 8
    return out


class ChunkStore:
    """Sorted chunk hashes with the bytes and the ids of each chunk. `joined` encodes chunks where they lie, (data, start, size) to
    (ids, number of ids of each), or gives None where it can't; without it chunks are encoded one by one."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int = MOST, most_bytes: int = MOST_BYTES, joined: Callable | None = None):
        self.encode, self.most, self.most_bytes, self.joined = encode, most, most_bytes, joined
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)  # of each slot, in ids; the last is the end
        self.ids = np.zeros(1 << 12, np.int32)
        self.at = np.zeros(1, np.int64)  # of each slot, in raw; the last is the end
        self.raw = np.zeros(1 << 12, np.uint8)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def _encoded(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of chunks."""
        if self.joined and (found := self.joined(data, start, size)):
            return found
        raw = data.tobytes()
        got = self.encode([raw[a : a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)])
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.concatenate([np.asarray(x, dtype=np.int32) for x in got]) if n.any() else np.zeros(0, np.int32), n

    def _add(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        ids, n = self._encoded(data, start, size)
        slot = np.arange(len(keys)) + len(self.first) - 1
        end, cut = self.first[-1] + np.cumsum(n), self.at[-1] + np.cumsum(size)
        self.ids, self.raw = _room(self.ids, int(end[-1])), _room(self.raw, int(cut[-1]) + 8)
        self.ids[self.first[-1] : end[-1]] = ids
        self.raw[self.at[-1] : cut[-1]] = data[T.ranges(start, size)]
        self.first, self.at = np.concatenate((self.first, end)), np.concatenate((self.at, cut))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slot)

    def encode_spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each span) of the spans data[start:end]."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = end - start
        keys, back = np.unique(T.span_hashes(data, start, end), return_inverse=True)
        one = np.empty(len(keys), np.int64)
        one[back] = np.arange(len(back))
        slot = self._find(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.keys) + len(new) > self.most or self.at[-1] + int(size[one[new]].sum()) > self.most_bytes:
                self.clear()
                new = np.arange(len(keys))
            self._add(keys[new], data, start[one[new]], size[one[new]])
            slot = self._find(keys)
        own = slot[back]
        odd = self.at[own + 1] - self.at[own] != size
        like = np.flatnonzero(~odd)
        odd[like] = differing(np.concatenate((data, np.zeros(8, np.uint8))), start[like], self.raw, self.at[own[like]], size[like])
        first, n = self.first[own], self.first[own + 1] - self.first[own]
        odd = np.flatnonzero(odd)
        if not len(odd):
            return self.ids[T.ranges(first, n)], n
        ids, n[odd] = self._encoded(data, start[odd], size[odd])
        first[odd] = self.first[-1] + np.cumsum(n[odd]) - n[odd]
        return np.concatenate((self.ids[: self.first[-1]], ids))[T.ranges(first, n)], n


def spans_of(data: np.ndarray, off: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first span and end span of each text): the texts cut at `cuts` and at their ends; empty texts have
    no span."""
    inner = np.ones(len(data) + 1, dtype=bool)
    inner[off] = False
    cuts = cuts[inner[cuts]]
    full = np.flatnonzero(np.diff(off) > 0)
    start = np.sort(np.concatenate((off[full], cuts)))
    end = np.concatenate((start[1:], off[-1:])) if len(start) else start
    return start, end, np.searchsorted(start, off[:-1]), np.searchsorted(start, off[1:])
