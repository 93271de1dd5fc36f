"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are short and documents long, so the Jaccard similarity of a document and an item it contains is near zero, and a
banded signature of whole documents would miss about a quarter of the contained items. The search therefore keeps the
MinHash on the items' side. Items are partitioned by their number of shingles, each partition up to `STEP_UP` times as large
as the one before; a partition of items with n shingles at most has bottom-k sketches of k = n - ceil(threshold * n) + 1
hashes. A document that holds `threshold` of an item's shingles misses fewer than k of them, so it holds one of the k smallest
at least: every contained item is a candidate, at any length of the document. Candidates are verified by the exact words of
their shingles.

Words are the runs of letters and digits of the lower-cased text; a shingle is `size` words, or all words of a shorter
item (so that short items are found inside texts, too). Items without a word match nothing. Null texts count as empty;
repeated rows give repeated results; a null id is kept. Extra columns are ignored.

The items' texts and sketches are sent to the executors only up to `max_items_bytes`, reckoned from what they take in memory;
beyond it the same search runs in pieces of the item table, each within the bound and each one pass over the documents.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import arrow, table

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of code points of the categories L and N in the lower-cased text."""
    low = (text or "").lower()
    if low.isascii():
        return _WORD.findall(low)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in low).split()


def shingles_of(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


_class: np.ndarray | None = None
_lower: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x3000: whether in a word, and the lower case (where that is one code point)."""
    global _class, _lower
    if _class is None:
        top = 0x3000
        _class = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(top)])
        _lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(top)], dtype=np.uint32)
    return _class, _lower


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word and end word of each text). Equal words have equal hashes."""
    data, off = T.spaced(data, off)
    if len(data) and data.max() < 128:
        low = T.LOWER[data]
        word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    else:
        text = data.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        cls, lower = _tables()
        if len(cp) and (cp.max() >= len(cls) or (cp == 0x130).any() or (cp == 0x3A3).any()):  # rare letters: the plain way
            lowered = [w for i in range(len(off) - 1) for w in (words_of(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")), )]
            flat = pa.array([x for w in lowered for x in w], pa.string())
            d, o = T.buffers(flat)
            n = np.cumsum([0, *map(len, lowered)])
            return T.span_hashes(d, o[:-1], o[1:]), n[:-1], n[1:]
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte of each code point
        off = np.searchsorted(at, off)
        word = cls[cp]
        low = lower[cp]
        # Bytes of the lowered text again, so that ASCII words hash alike in both ways.
        keep = np.where(word, low, np.uint32(32))
        raw = np.frombuffer(keep.tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
        pos = np.concatenate((np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]))
        start, end = T.runs(word)
        h = T.span_hashes(raw, pos[start], pos[end])
        return h, np.searchsorted(start, off[:-1]), np.searchsorted(start, off[1:])
    start, end = T.runs(word)
    return T.span_hashes(low, start, end), np.searchsorted(start, off[:-1]), np.searchsorted(start, off[1:])


_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` words its hash; runs that leave a text are made, too, and have to be masked."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _STEP[0] + _STEP[1]
    return T.mix(out)


def hash_shingle(words: tuple[str, ...]) -> int:
    d, o = T.buffers(pa.array(words, pa.string()))
    return int(shingle_hashes(T.span_hashes(d, o[:-1], o[1:]), len(words))[0])


STEP_UP = 1.25


def partition_of(n: np.ndarray) -> np.ndarray:
    """The largest number of shingles of the partition that items with n shingles are in."""
    at = np.ceil(np.log(np.maximum(n, 1)) / math.log(STEP_UP) - 1e-9)
    return np.maximum(np.floor(STEP_UP**at + 1e-9).astype(np.int64), n)


def sketch_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


class Sketches:
    """The items' bottom-k sketches: by words a shingle, sorted hashes and the items that each belongs to."""

    def __init__(self, items: list[tuple[int, str]], size: int, threshold: float):
        self.threshold, self.items = threshold, items
        data, off = T.buffers(pa.array([t for _, t in items], pa.large_string()))
        h, lo, hi = word_hashes(data, off)
        n_words = hi - lo
        self.words = np.minimum(n_words, size)  # of a shingle, 0 for items without a word
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words[self.words > 0]).tolist():
            own = np.flatnonzero(self.words == w)
            n = n_words[own] - w + 1  # repeats included: a longer sketch at most
            sh = shingle_hashes(h, w)[T.ranges(lo[own], n)]
            item = np.repeat(own, n)
            order = np.lexsort((sh, item))
            sh, item = sh[order], item[order]
            new = np.concatenate(([True], (sh[1:] != sh[:-1]) | (item[1:] != item[:-1])))
            sh, item = sh[new], item[new]
            rank = np.arange(len(sh)) - np.searchsorted(item, item)
            keep = rank < sketch_length(partition_of(n), threshold)[np.searchsorted(own, item)]
            order = np.argsort(sh[keep], kind="stable")
            keys, first = np.unique(sh[keep][order], return_index=True)
            self.by[w] = keys, np.append(first, keep.sum()).astype(np.int64), item[keep][order]
        self.tops: dict[int, np.ndarray] = {}
        self.sets: dict[int, set] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tops": {}, "sets": {}}

    def seen(self, n: int) -> np.ndarray:
        """For the 24 highest bits of a hash, whether a sketch of this shingle size has them; made once a worker."""
        if n not in self.tops:
            self.tops[n] = np.zeros(1 << 24, dtype=bool)
            self.tops[n][(self.by[n][0] >> np.uint64(40)).astype(np.int64)] = True
        return self.tops[n]

    def candidates(self, data: np.ndarray, off: np.ndarray) -> dict[int, set[int]]:
        """Text index to the positions of candidate items."""
        found: dict[int, set[int]] = {}
        h, lo, hi = word_hashes(data, off)
        for n, (keys, first, owners) in self.by.items():
            sh = shingle_hashes(h, n)
            hits = np.flatnonzero(self.seen(n)[(sh >> np.uint64(40)).astype(np.int64)])
            if not len(hits):
                continue
            at = np.searchsorted(keys, sh[hits])
            at[at == len(keys)] = 0
            same = keys[at] == sh[hits]
            hits, at = hits[same], at[same]
            doc = np.searchsorted(lo, hits, side="right") - 1
            inside = hits + n <= hi[doc]
            for d, a in set(zip(doc[inside].tolist(), at[inside].tolist(), strict=True)):
                found.setdefault(d, set()).update(owners[first[a] : first[a + 1]].tolist())
        return found

    def _set(self, i: int) -> set:
        if i not in self.sets:
            if len(self.sets) >= 10_000:
                self.sets.clear()
            self.sets[i] = shingles_of(words_of(self.items[i][1]), int(self.words[i]))
        return self.sets[i]

    def verify(self, text: str, items: set[int]) -> Iterator[tuple[int, int, int]]:
        """(item_id, shingles of the item, those in the text) of the candidates that reach the threshold."""
        words = words_of(text)
        made: dict[int, set] = {}
        for i in sorted(items):
            n = int(self.words[i])
            if not n:
                continue
            if n not in made:
                made[n] = shingles_of(words, n)
            sh = self._set(i)
            common = len(sh & made[n])
            if common >= self.threshold * len(sh) - 1e-9:
                yield self.items[i][0], len(sh), common


def _pieces(items: DataFrame, id_col: str, text_col: str, bound: int) -> Iterator[list[tuple[int, str]]]:
    """The item table in pieces that take `bound` bytes at most with their sketches (one larger text: a piece of its own)."""
    piece, held = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        text = r["t"] or ""
        n = 200 + 2 * sys.getsizeof(text) + 24 * (text.count(" ") // 2)  # text, and hash, owner and bounds of each sketch entry
        if piece and held + n > bound:
            yield piece
            piece, held = [], 0
        piece.append((r["i"], r["t"]))
        held += n
    if piece:
        yield piece


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    max_items_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) of every document and item whose containment, the share of
    the item's distinct shingles that the document has, is `threshold` at least."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shingles long, n_common long, containment double"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for piece in _pieces(items, "item_id", "text", max_items_bytes):
        sketches = spark.sparkContext.broadcast(Sketches(piece, size, threshold))

        def run(batches: Iterator[pa.RecordBatch], sketches=sketches) -> Iterator[pa.RecordBatch]:
            held = sketches.value
            for b in batches:
                rows = []
                for first, _, data, off in T.slices(b.column(1)):
                    for d, its in held.candidates(data, off).items():
                        doc = b.column(0)[first + d].as_py()
                        for item, n, common in held.verify(b.column(1)[first + d].as_py(), its):
                            rows.append((doc, item, n, common, common / n))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_common", "containment"])

        part = arrow(src, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    max_items_bytes: int = 64 << 20,
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` that contain no item, with all their columns; one pass and no join for each piece of items."""
    for piece in _pieces(items, "item_id", "text", max_items_bytes):
        sketches = docs.sparkSession.sparkContext.broadcast(Sketches(piece, size, threshold))
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], sketches=sketches, at=at) -> Iterator[pa.RecordBatch]:
            held = sketches.value
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for first, _, data, off in T.slices(b.column(at)):
                    for d, its in held.candidates(data, off).items():
                        keep[first + d] = next(held.verify(b.column(at)[first + d].as_py(), its), None) is None
                yield b.filter(pa.array(keep)) if not keep.all() else b

        docs = arrow(docs, run, docs.schema)
    return docs


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS k,
    array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k)
),
hits AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, c::BIGINT AS n_common, c::DOUBLE / n AS containment
FROM hits JOIN bn USING (item_id) WHERE c >= 0.8 * n - 1e-9
"""
