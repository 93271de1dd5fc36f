"""Chat formatting: whole conversations rendered by a template, encoded once, with a loss mask aligned by offsets.

A turn is rendered as start, role, sep, text, end. The three marks are special tokens of the encoding, so no token reaches over a
turn's border. Roles and texts are escaped reversibly: `<`, any number of backslashes and `|` get one more backslash, so an escaped
text holds no `<|`, with which all control strings begin; unescaping takes one backslash away. Every string comes back as it was.

Turns are dealt by ranges of (conversation, turn, role, hash of the text), so a conversation of any length spreads over tasks.
Each task renders its run of turns in segments (whole turns; a segment ends with the turn that passes `segment` bytes), encodes
the rendered bytes once by distinct chunks, and gets each token's byte offsets from the lengths of the tokens. The spans of the
texts to learn from are sorted, and so are the tokens: two binary searches a span give its first and last token.

A row of the output is a segment:

    <conversation>    the conversation's id
    part, seg         segments of a conversation follow each other in this order
    whole             whether the segment is its whole conversation
    ids               token ids
    loss_from, loss_to   token ranges (end exclusive) of the loss mask, ascending

Defined results. Null texts and roles are empty. Turns are ordered by turn (null first), then role, then the hash of the text;
repeated rows are turns each. Rows with a null id are one conversation. Empty and very long texts are turns like any other; an
empty text has an empty range. An empty table gives no rows. Columns other than the four named ones don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text as T
from ._common import CACHES, arrow, table
from .pieces import ChunkStore, spans_of
from .token_file import public_path

SEGMENT = 1 << 18
#: Rendered bytes that are encoded together.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    learn: str = "assistant"

    def __post_init__(self):
        if not all(re.fullmatch(r"<\|[^<]+", m) for m in self.marks) or len(set(self.marks)) < 3:
            raise ValueError("marks are three different strings that begin with <|")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.start, self.sep, self.end


_PLAIN, _ESCAPED = re.compile(rb"<(\\*)\|"), re.compile(rb"<\\(\\*)\|")


def escape(text: bytes) -> bytes:
    return _PLAIN.sub(rb"<\\\1|", text) if b"<" in text else text


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text) if b"<" in text else text


def token_bytes(vocab: dict[str, int]) -> dict[int, bytes]:
    """The bytes of the tokens of a byte-level vocabulary: printable Latin-1 characters stand for themselves, and the 68 other
    bytes, ascending, for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in own]
    of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
    return {i: bytes(of[c] for c in t) for t, i in vocab.items() if all(c in of for c in t)}


class Encoding:
    """A byte-level tokenizer with the template's marks as special tokens."""

    def __init__(self, path: str, template: Template):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens(list(template.marks))
        self.start, self.sep, self.end = (t.token_to_id(m) for m in template.marks)
        of = token_bytes(json.loads(t.to_str())["model"]["vocab"])
        of |= {t.token_to_id(m): m.encode() for m in template.marks}
        self.size = np.zeros(max(of) + 1, np.int64)
        self.size[list(of)] = [len(b) for b in of.values()]
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.raw = np.frombuffer(b"".join(of.get(i, b"") for i in range(len(self.size))), np.uint8)

        def encode(chunks: list[bytes]) -> list[list[int]]:
            out: list[list[int]] = []
            for lo in range(0, len(chunks), 20_000):
                part = [c.decode("utf-8") for c in chunks[lo : lo + 20_000]]
                out += [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
            return out

        self.store = ChunkStore(encode)

    def encode(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Ids of rendered bytes; `borders` are the starts and ends of the marks, which no token reaches over."""
        off = np.array([0, len(data)])
        start, end, _, _ = spans_of(data, off, np.unique(np.concatenate((T.chunk_cuts(data), borders))))
        return self.store.encode_spans(data, start, end)[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.raw[T.ranges(self.first[ids], self.size[ids])].tobytes()


_held: dict = CACHES["chat"]


def encoding(path: str, template: Template) -> Encoding:
    if (path, template) not in _held:
        _held[path, template] = Encoding(path, template)
    return _held[path, template]


def mask(ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the end token of each sorted byte span, by the tokens' ascending end offsets."""
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(ends, spans[:, 1], side="left") + 1  # the token that reaches the span's end
    return first, np.where(spans[:, 1] > spans[:, 0], last, first)


@dataclass
class _Segment:
    conv: object
    opens: bool
    whole: bool = False

    def __post_init__(self):
        self.parts: list[bytes] = []  # start, role, sep, text, end of each turn
        self.learn: list[bool] = []
        self.size = 0


def _renderer(template: Template, segment: int):
    s, m, e = (x.encode() for x in template.marks)

    def add(seg: _Segment, role: str | None, text: str | None) -> bool:
        """Adds a turn; whether the segment is full."""
        r, t = escape((role or "").encode()), escape((text or "").encode())
        seg.parts += (s, r, m, t, e)
        seg.learn.append(role == template.learn)
        seg.size += len(s) + len(r) + len(m) + len(t) + len(e)
        return seg.size >= segment

    return add


def render(df: DataFrame, tokenizer: str, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The segments of all conversations, as the module describes them."""
    rows = df.select(F.col(conv), F.col(turn), F.col(role).cast("string").alias("__role"), F.col(text).cast("string").alias("__text"))
    order = [F.col(c).asc_nulls_first() for c in (conv, turn, "__role")] + [F.xxhash64("__text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(conv, "__role", "__text", F.spark_partition_id().alias("__part"))
    schema = StructType([df.schema[conv], *StructType.fromDDL("part int, seg int, whole boolean, ids array<int>, loss_from array<int>, loss_to array<int>").fields])
    add = _renderer(template, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ready, size, no, kind, part = encoding(tokenizer, template), [], 0, 0, None, 0

        def flush() -> pa.RecordBatch:
            nonlocal ready, size, no
            b = _encoded(enc, ready, kind, part, no, conv)
            no, ready, size = no + len(ready), [], 0
            return b

        seg, first = None, True
        for b in batches:
            kind = b.schema.field(conv).type
            convs, roles, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            part = b.column(3)[0].as_py() if b.num_rows else part
            for i, c in enumerate(convs):
                if seg is not None and c != seg.conv:
                    seg.whole = seg.opens and not first  # another conversation came before and comes after
                    ready.append(seg)
                    size, first, seg = size + seg.size, False, None
                    if size >= TOGETHER:
                        yield flush()
                if seg is None:
                    seg = _Segment(c, True)
                if add(seg, roles[i], texts[i].as_py()):
                    # A full segment is its whole conversation only if the next row is another one's; the rest goes on in a new one.
                    last = i + 1 < len(convs) and convs[i + 1] != c
                    seg.whole = last and seg.opens and not first
                    ready.append(seg)
                    size, first = size + seg.size, first and not last
                    seg = None if last else _Segment(c, False)
                    if size >= TOGETHER:
                        yield flush()
        if seg is not None and seg.parts:
            ready.append(seg)
        if ready:
            yield flush()

    return arrow(rows, run, schema, "chat")


def _encoded(enc: Encoding, segments: list[_Segment], kind: pa.DataType, part: int, no: int, conv: str) -> pa.RecordBatch:
    parts = [p for s in segments for p in s.parts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    off = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
    at = np.arange(0, len(parts), 5)
    borders = np.concatenate((off[at], off[at + 1], off[at + 2], off[at + 3], off[at + 4], off[at + 5]))
    ids = enc.encode(data, borders)
    ends = np.cumsum(enc.size[ids])
    turns = np.array([len(s.learn) for s in segments])
    upto = np.concatenate(([0], np.cumsum(turns)))
    cut = np.searchsorted(ends, off[5 * upto], side="right")  # the first token of each segment, and the end
    cut[0] = 0
    learn = np.flatnonzero(np.concatenate([s.learn for s in segments]))
    of = np.searchsorted(upto, learn, side="right") - 1
    a, z = mask(ends, np.stack([off[5 * learn + 3], off[5 * learn + 4]], axis=1))
    count = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(segments))))).astype(np.int32)
    ranges = [pa.ListArray.from_arrays(pa.array(count), pa.array((x - cut[of]).astype(np.int32))) for x in (a, z)]
    n = len(segments)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s.conv for s in segments], kind), pa.array([part] * n, pa.int32()), pa.array(np.arange(no, no + n, dtype=np.int32)), pa.array([s.whole for s in segments]),
            pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))), *ranges,
        ],
        names=[conv, "part", "seg", "whole", "ids", "loss_from", "loss_to"],
    )


def turns_of(ids: np.ndarray, enc: Encoding) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a segment's ids, unescaped."""
    s, m, e = (np.flatnonzero(ids == x) for x in (enc.start, enc.sep, enc.end))
    return [(unescape(enc.decode(ids[a + 1 : b])), unescape(enc.decode(ids[b + 1 : c]))) for a, b, c in zip(s, m, e, strict=True)]


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame, tokenizer: str, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """Per conversation what its segments hold, read back from ids and mask. Segments that are whole conversations are digested
    where they are; the bytes of the others meet in order, one segment at a time in memory."""
    head = segments.schema[conv]
    schema = StructType([head, *StructType.fromDDL(f"part int, seg int, {_DIGEST}, turns binary, loss binary").fields])
    names = [f.name for f in schema.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, template)
        for b in batches:
            rows, flat, off = [], b.column("ids").flatten().to_numpy(), b.column("ids").offsets.to_numpy()
            off = off - off[0]
            for i in range(b.num_rows):
                ids = flat[off[i] : off[i + 1]]
                turns = turns_of(ids, enc)
                said = b"".join(x for r, t in turns for x in (r, b"\n", t, b"\n"))
                lo, hi = b.column("loss_from")[i].as_py(), b.column("loss_to")[i].as_py()
                loss = b"".join(unescape(enc.decode(ids[a:z])) for a, z in zip(lo, hi, strict=True))
                chars = len(enc.decode(ids).decode())
                base = (b.column(conv)[i].as_py(), b.column("part")[i].as_py(), b.column("seg")[i].as_py(), len(turns))
                if b.column("whole")[i].as_py():
                    rows.append((*base, hashlib.sha256(said).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest(), chars, None, None))
                else:
                    rows.append((*base, None, len(loss.decode()), None, chars, said, loss))
            kinds = [b.schema.field(conv).type, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, kind = None, [], None  # held: [conversation, turns, digest, characters, digest, characters]

        def close() -> None:
            out.append((held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]))

        def flush() -> pa.RecordBatch:
            nonlocal out
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            b, out = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names=[conv, *names[3:8]]), []
            return b

        for b in batches:
            kind = b.schema.field(conv).type
            cols = [b.column(j) for j in range(len(names))]
            for i in range(b.num_rows):
                c, n, sha, loss_n, loss_sha, chars = (cols[j][i].as_py() for j in (0, 3, 4, 5, 6, 7))
                if held is not None and (sha is not None or c != held[0]):
                    close()
                    held = None
                if sha is not None:
                    out.append((c, n, sha, loss_n, loss_sha, chars))
                    continue
                held = held or [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[2].update(cols[8][i].as_py())
                held[4].update(cols[9][i].as_py())
                for j, x in ((1, n), (3, loss_n), (5, chars)):
                    held[j] += x
            if out:
                yield flush()
        if held is not None:
            close()
            yield flush()

    parts = arrow(segments, read, schema, "chat").repartition(conv)
    parts = parts.sortWithinPartitions(F.col(conv).asc_nulls_first(), "part", "seg")
    return arrow(parts, join, StructType([head, *StructType.fromDDL(_DIGEST).fields]))


#: The conversation that the query adds.
_ADDED = "<|im_end|><|im_start|>assistant ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and conversation -1, read back from the formatted segments."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ADDED).alias("text")
    )
    path = public_path("byte_bpe_50k.json")
    return digests(render(rows.unionByName(added), path), path)


OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_ADDED}' UNION ALL SELECT -1, 1, 'assistant', '{_ADDED}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({sum(map(len, Template().marks))} + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
