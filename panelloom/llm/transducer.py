"""Subword encoding and decoding by weighted finite-state transducers over the tropical semiring.

`Model` reads a SentencePiece model file (pieces, scores, kinds, normaliser rules and switches) and compiles three machines of
arcs (input, next state) with outputs and weights at their final states:

* the normaliser (`Normaliser`): a machine of the rules of the character map, whose paths read the longest rule and write its
  replacement, between two states of white space: after a space (where more spaces write nothing, if the model squeezes them)
  and after anything else. It starts by writing the dummy prefix. Without rules every character writes itself;
* the pieces (`Transducer.pieces`): a path reads the characters of a piece and writes its id. The machine's states are
  the last piece written. For a merge (BPE) model an arc from piece a to piece b weighs 0 if merging the characters of ab in
  score order gives just (a, b), and infinity (the semiring's zero) else; a sequence of pieces is what the merges give if
  and only if each neighbouring pair is, so the shortest path is the merge result. For a unigram model an arc weighs the
  negative score of its piece;
* byte fallback (`Transducer.fallback`): a character that is no piece reads as its UTF-8 bytes, at a weight above any path of
  pieces (merge models) or at the least score's less 10 (unigram models). Without byte pieces, characters in a row that are no
  piece are one unknown id.

A text is composed with these from left to right, arcs being made as the text reaches them, and the shortest path to each
position is kept. Pieces have U+2581 at their start only (checked; else whole texts are one chunk), so normalised texts are cut
before a space that follows another character, and each distinct chunk is composed once a worker.

Null and empty texts have no ids. Decoding gives back the normalised text: all of it, but for U+2581 read as a space; null
ids are a null text.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import CACHES, arrow, table
from .pieces import ChunkStore, spans_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file format


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + n]
            at += n


class Machine:
    """Arcs by character from state to state; a final state has an output and a weight. State 0 starts."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.output: list = [None]
        self.weight: list[float] = [math.inf]

    def add(self, path: str, output, weight: float = 0.0) -> None:
        at = 0
        for ch in path:
            new = self.arcs[at].get(ch)
            if new is None:
                new = self.arcs[at][ch] = len(self.arcs)
                self.arcs.append({})
                self.output.append(None)
                self.weight.append(math.inf)
            at = new
        self.output[at], self.weight[at] = output, weight

    def longest(self, text: str, at: int) -> tuple[int, str] | None:
        """(end, output) of the longest path from `at` that ends in a final state."""
        state, found, k = 0, None, at
        while k < len(text):
            state = self.arcs[state].get(text[k], -1)
            if state < 0:
                break
            k += 1
            if self.output[state] is not None:
                found = k, self.output[state]
        return found


def char_rules(charsmap: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: the size of a double-array trie of 32-bit units, the trie over UTF-8 bytes, and
    the replacements, each ended by a zero byte, to whose offsets its values point. A unit has its label in the low byte (and
    the top bit in units of values), in bit 8 whether a value follows, and from bit 10 on the offset to its children, eight
    bits further up where bit 9 is set."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    unit = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64)
    texts, rules = charsmap[4 + size :], {}
    below = lambda u: (u >> 10) << ((u & 512) >> 6)
    byte, open_ = np.arange(256), [(b"", int(below(unit[0])))]
    while open_:
        path, base = open_.pop()
        at = base ^ byte
        inside = at < len(unit)
        for c in byte[inside][unit[at[inside]] & 0x800000FF == byte[inside]].tolist():
            if not c:
                continue
            u = int(unit[base ^ c])
            child = (base ^ c) ^ below(u)
            if u >> 8 & 1:
                first = int(unit[child]) & 0x7FFFFFFF
                rules[(path + bytes([c]))] = texts[first : texts.index(0, first)].decode()
            open_.append((path + bytes([c]), child))
    return {k.decode(): v for k, v in rules.items()}


class Normaliser:
    def __init__(self, charsmap: bytes, dummy_prefix: bool, squeeze: bool):
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.rules = Machine()
        rules = char_rules(charsmap)
        for key, text in rules.items():
            self.rules.add(key, text)
        self.identity = not rules and not squeeze
        # Where a path can leave the state after other characters: the first characters of rules, and spaces.
        self.starts = re.compile("[" + "".join(re.escape(c) for c in sorted({k[0] for k in rules} | {" "})) + "]")

    def __call__(self, text: str) -> str:
        """The normalised text, with spaces for U+2581."""
        out: list[str] = []
        at, n, spaced = 0, len(text), self.squeeze
        while at < n:
            m = self.starts.search(text, at)
            to = m.start() if m else n
            if to > at:
                out.append(text[at:to])
                at, spaced = to, False
                continue
            at, part = self.rules.longest(text, at) or (at + 1, text[at])
            if spaced:
                part = part.lstrip(" ")
            if part:
                out.append(part)
                spaced = self.squeeze and part[-1] == " "
        whole = "".join(out)
        if whole and self.dummy_prefix:
            whole = " " + whole
        return whole.rstrip(" " + SPACE) if self.squeeze else whole


class Model:
    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze, charsmap = 1, True, True, b""
        for no, value in _fields(raw):
            if no == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif no == 2:
                self.kind = dict(_fields(value)).get(3, 1)  # 1 unigram, 2 merges
            elif no == 3:
                x = dict(_fields(value))
                charsmap = x.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(x.get(3, 1)), bool(x.get(4, 1))
        self.normal = Normaliser(charsmap, self.dummy_prefix, self.squeeze)
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.splits = all(SPACE not in p.lstrip(SPACE) for p in self.id_of) and (bool(self.byte_id) or SPACE in self.id_of)


class Transducer:
    MOST = 400_000  # weights kept

    def __init__(self, model: Model):
        self.model = model
        self.pieces = Machine()
        for p, i in model.id_of.items():
            self.pieces.add(p, i, -model.scores[i])
        least = min((model.scores[i] for i in model.id_of.values()), default=0.0)
        self.off_pieces = 1e6 if model.kind == 2 else 10.0 - least  # weight of a character that is no piece
        self.size = len(model.pieces)
        self.weights: dict[int, float] = {}  # by a * size + b

    def merged(self, chars: list[str]) -> list[str]:
        """What merging in score order makes of the characters (ties: the leftmost pair)."""
        ids, scores = self.model.id_of, self.model.scores
        parts = list(chars)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, a: int, b: int) -> float:
        """Of the arc that writes piece b after piece a; a is -1 at the start and after byte fallback."""
        if self.model.kind != 2:
            return -self.model.scores[b]
        if len(self.weights) > self.MOST:
            self.weights.clear()
        x, y = self.model.pieces[a] if a >= 0 else "", self.model.pieces[b]
        w = self.weights[a * self.size + b] = 0.0 if self.merged(list(x + y)) == ([x, y] if x else [y]) else math.inf
        return w

    def shortest(self, text: str) -> list[int]:
        """Ids along the shortest path of a normalised text. Of the states at a position only the best can go on: under
        merges each prefix has one path of finite weight, and unigram weights don't look back."""
        n, arcs, output, weights, size, off = len(text), self.pieces.arcs, self.pieces.output, self.weights, self.size, self.off_pieces
        best, last, before = [math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == math.inf:
                continue
            a, state, j = last[i] * size, arcs[0].get(text[i]), i + 1
            known = state is not None and output[state] is not None
            while state is not None:
                b = output[state]
                if b is not None:
                    w = weights.get(a + b)
                    if w is None:
                        w = self.weight(last[i], b)
                    if here + w < best[j]:
                        best[j], last[j], before[j] = here + w, b, i
                if j == n:
                    break
                state = arcs[state].get(text[j])
                j += 1
            if not known and here + off < best[i + 1]:
                best[i + 1], last[i + 1], before[i + 1] = here + off, -1, i
        out: list[int] = []
        at, joined = n, False
        while at:
            i = before[at]
            if last[at] >= 0:
                out.append(last[at])
                joined = False
            elif self.model.byte_id:  # read backwards
                out.extend(self.fallback(text[i])[::-1])
            elif not joined:
                out.append(self.model.unknown)
                joined = True
            at = i
        return out[::-1]

    def fallback(self, char: str) -> list[int]:
        byte = self.model.byte_id
        return [byte.get(x, self.model.unknown) for x in char.encode()]


class Codec:
    """Encodes and decodes batches; one for each model file and worker."""

    def __init__(self, raw: bytes):
        self.model = Model(raw)
        self.machine = Transducer(self.model)
        self.store = ChunkStore(self._chunks)
        of = {i: bytes([x]) for x, i in self.model.byte_id.items()}
        for i, (p, k) in enumerate(zip(self.model.pieces, self.model.kinds, strict=True)):
            if k == CONTROL:
                of[i] = b""
            elif k == UNKNOWN:
                of[i] = " ⁇ ".encode()
            elif i not in of:
                of[i] = p.replace(SPACE, " ").encode()
        self.bytes_of = [of[i] for i in range(len(self.model.pieces))]

    def _chunks(self, chunks: list[bytes]) -> list[list[int]]:
        return [self.machine.shortest(c.decode("utf-8", "replace").replace(" ", SPACE)) for c in chunks]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        if not self.model.normal.identity:
            raw = data.tobytes()
            texts = [self.model.normal(raw[a:z].decode("utf-8", "replace")).encode() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        elif self.model.dummy_prefix:  # the same without rules: a space before every text that is not empty
            full = (np.diff(off) > 0).astype(np.int64)
            new = off + np.concatenate(([0], np.cumsum(full)))
            out = np.full(int(new[-1]), 32, dtype=np.uint8)
            out[T.ranges(new[:-1] + full, np.diff(off))] = data
            data, off = out, new
        cuts = np.zeros(0, np.int64)
        if self.model.splits and len(data) > 1:
            at = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
            same = (data[at - 1] == 0x81) & (at >= 3) & (data[np.maximum(at - 2, 0)] == 0x96) & (data[np.maximum(at - 3, 0)] == 0xE2)
            cuts = at[~same]
        start, end, lo, hi = spans_of(data, off, cuts)
        ids, size = self.store.encode_spans(data, start, end)
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids, upto[hi] - upto[lo]

    def decode(self, ids: np.ndarray) -> str:
        parts = list(map(self.bytes_of.__getitem__, ids.tolist()))
        if self.model.dummy_prefix or self.model.squeeze:  # one space at the start; with squeezing one of each piece until there is text
            for k, part in enumerate(parts):
                if self.model.pieces[ids[k]].startswith(SPACE):
                    parts[k] = part[1:]
                if parts[k] or part and not self.model.squeeze:
                    break
        return b"".join(parts).decode("utf-8", "replace")


_codecs: dict[str, Codec] = CACHES["pieces"]


def codec(path: str) -> Codec:
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(f.read())
    return _codecs[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", drop_text: bool = True) -> DataFrame:
    """`docs` with `ids` (array<int>) and `n_ids`, without its text unless asked for. `path` is the model file, an
    installed resource that each executor has. Columns named ids or n_ids are replaced."""
    kept = [c for c in docs.columns if c not in ("ids", "n_ids") and not (drop_text and c == text_col)]
    src = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for first, end, data, off in T.slices(b.column(at), 1 << 20):
                ids, n = c.encode(data, off)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids, pa.int32()))
                part = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], lists, pa.array(n, pa.int64())], names=[*kept, "ids", "n_ids"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:at]]
    return arrow(src, run, ", ".join([*fields, "ids array<int>", "n_ids long"]), "pieces")


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`df` with `text` in place of its ids."""
    kept = [c for c in df.columns if c not in (ids_col, "text")]
    src = df.select(*kept, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            col = b.column(len(kept))
            off, flat = col.offsets.to_numpy().astype(np.int64), col.values.to_numpy(zero_copy_only=False)
            there = col.is_valid().to_pylist()
            text = [c.decode(flat[a:z]) if ok else None for a, z, ok in zip(off[:-1], off[1:], there, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(text, pa.string())], names=[*kept, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(kept)]]
    return arrow(src, run, ", ".join([*fields, "text string"]), "pieces")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_crc32, round_trip): ids_crc32 of the ids as little-endian 32-bit integers,
    decoded_crc32 of the decoded text's UTF-8 bytes, round_trip whether that is the text (null: empty)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for first, end, data, off in T.slices(b.column(1), 1 << 20):
                ids, n = c.encode(data, off)
                rows = []
                for k, part in enumerate(np.split(ids, np.cumsum(n)[:-1])):
                    back = c.decode(part).encode()
                    raw = data[off[k] : off[k + 1]].tobytes()
                    rows.append((zlib.crc32(part.astype("<u4").tobytes()), zlib.crc32(back), back == raw))
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(n, pa.int64()), *cols], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    return arrow(src, run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean", "pieces")


def op7_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import public_path

    return round_trips(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))
