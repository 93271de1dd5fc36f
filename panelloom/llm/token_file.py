"""Token files: documents as ids in ascending id order, in bit- or byte-plane shuffled blocks with a chunk index.

File format (a table, so that any store that Spark writes can hold it; one row is one segment of whole documents):

    file_no, seg_no   position of the segment; segments in this order have ascending doc_id
    ids_before        ids of the file before this segment
    n_docs, n_ids     of the segment
    docs              little-endian records of each document: doc_id as int64, ids as uint32, null flag of doc_id as uint8
    blocks            little-endian records of each block of up to `block` ids: ids as uint32, planes as uint32, then for
                      each plane its byte offset and its length (uint32) in `planes`; length 0: the plane is all zero
    planes            the planes, each compressed with zstandard

A block of n ids is transposed: its plane p is byte p (or bit p, packed eight to a byte) of each id, lowest first.

Documents are dealt by ranges of doc_id, so each file is one task's share; ranges come from the ids alone, and rows with one
id stay together in text order. Null texts are empty documents, null ids come first. Nothing is cut off: a segment ends with
the document that reaches `segment` ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import CACHES, Scratch, arrow, table
from .pieces import ChunkStore, spans_of

SEGMENT = "file_no int, seg_no int, ids_before long, n_docs int, n_ids long, docs binary, blocks binary, planes binary"
_NAMES = ["file_no", "seg_no", "ids_before", "n_docs", "n_ids", "docs", "blocks", "planes"]
_DOC = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("null", "u1")])


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: np.ndarray, block: int = 1 << 16, planes: str = "byte", level: int = 1) -> tuple[bytes, bytes]:
    """(blocks, planes) of uint32 ids."""
    import zstandard

    z, index, out, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for lo in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[lo : lo + block], dtype="<u4")
        by = part.view(np.uint8).reshape(-1, 4).T
        if planes == "bit":
            by = _bits(part)
        index += [len(part), len(by)]
        for p in by:
            raw = z.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b""
            index += [at, len(raw)]
            out.append(raw)
            at += len(raw)
    return np.array(index, dtype="<u4").tobytes(), b"".join(out)


def _bits(part: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")  # ids x 32
    return np.packbits(bits.T, axis=1, bitorder="little")


def unpack(blocks: bytes, planes: bytes) -> np.ndarray:
    import zstandard

    z, index, at, out = zstandard.ZstdDecompressor(), np.frombuffer(blocks, dtype="<u4"), 0, []
    while at < len(index):
        n, k = int(index[at]), int(index[at + 1])
        width = n if k == 4 else -(-n // 8)
        by = np.zeros((k, width), dtype=np.uint8)
        for p in range(k):
            first, size = int(index[at + 2 + 2 * p]), int(index[at + 3 + 2 * p])
            if size:
                by[p] = np.frombuffer(z.decompress(planes[first : first + size], max_output_size=width), dtype=np.uint8)
        if k != 4:
            by = np.packbits(np.unpackbits(by, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little").T
        out.append(np.ascontiguousarray(by.T).view("<u4").reshape(-1))
        at += 2 + 2 * k
    return np.concatenate(out) if out else np.zeros(0, "<u4")


#: Bytes of a text of joined chunks.
JOINED = 1 << 16


def byte_lengths(tokenizer: str) -> np.ndarray | None:
    """Bytes of each id (0: no such id) of a byte-level tokenizer whose ids tile the text; None for any other."""
    import json

    t = json.loads(tokenizer)
    pre, model = t.get("pre_tokenizer") or {}, t["model"]
    same = not (t.get("normalizer") or t.get("truncation") or t.get("padding")) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
    own = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    if not same or model.get("type") != "BPE" or any(model.get(x) for x in own) or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in t["added_tokens"]):
        return None
    size = {i: len(x) for x, i in model["vocab"].items()} | {x["id"]: len(x["content"].encode()) for x in t["added_tokens"]}
    out = np.zeros(max(size) + 1, np.int64)
    out[list(size)] = list(size.values())
    return out


def join(encode: Callable[[list[str]], list[list[int]]], length: np.ndarray) -> Callable:
    """Encodes chunks as texts of many: two are joined only where `chunk_cuts` would part them again, so that no token reaches
    over, and the ids are parted by their bytes."""

    def joined(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        text, end = data[T.ranges(start, size)], np.cumsum(size)
        cut = np.zeros(len(text) + 1, dtype=bool)
        cut[T.chunk_cuts(text)] = True
        first = end - size
        new = ~cut[first]
        new[1:] |= first[1:] // JOINED != first[:-1] // JOINED
        at, raw = first[new].tolist(), text.tobytes()
        got = encode([raw[a:z].decode("utf-8") for a, z in zip(at, [*at[1:], len(raw)], strict=True)])
        ids = np.concatenate([np.array(x, dtype=np.int32) for x in got]) if got else np.zeros(0, np.int32)
        edge = np.cumsum(length[ids])
        last = np.searchsorted(edge, end)
        if not len(edge) or edge[-1] != len(text) or (edge[last] != end).any():
            return None
        return ids, np.diff(last, prepend=-1)

    return joined


_stores: dict[str, ChunkStore] = CACHES["tokens"]


def _store(path: str) -> ChunkStore:
    if path not in _stores:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)

        def encode(chunks: list[bytes]) -> list[list[int]]:
            out: list[list[int]] = []
            for lo in range(0, len(chunks), 20_000):
                part = [c.decode("utf-8") for c in chunks[lo : lo + 20_000]]
                out += [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
            return out

        length = byte_lengths(t.to_str())
        batch = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        _stores[path] = ChunkStore(encode, joined=None if length is None else join(batch, length))
    return _stores[path]


def encode_texts(data: np.ndarray, off: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text), the end id included. Chunks begin at a white space after a printable character:
    the tokenizer's own splits never reach over such a place, nor look back over it."""
    start, end, lo, hi = spans_of(data, off, T.chunk_cuts(data))
    ids, size = _store(path).encode_spans(data, start, end)
    upto = np.concatenate(([0], np.cumsum(size)))
    n = upto[hi] - upto[lo]
    out = np.full(len(ids) + len(n), end_id, dtype=np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    block: int = 1 << 16,
    planes: str = "byte",
    segment: int = 1 << 19,
    docs_per_file: int = 8_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the token file of `docs` under `path`."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.select(id_col).count()
    files = max(1, min(100_000, -(-rows // docs_per_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = seg = before = 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seg, before, held, size
            ids = np.concatenate([h[0] for h in held])
            info = np.concatenate([h[1] for h in held])
            b, p = pack(ids, block, planes)
            row = [no, seg, before, len(info), len(ids), info.tobytes(), b, p]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            seg, before, held, size = seg + 1, before + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=_NAMES)

        for b in batches:
            no = b.column(0)[0].as_py() if b.num_rows else no
            keys = b.column(1)
            for first, end, data, off in T.slices(b.column(2), 1 << 20):
                ids, n = encode_texts(data, off, tokenizer, end_id)
                info = np.zeros(end - first, dtype=_DOC)
                part = keys.slice(first, end - first)
                info["doc_id"] = part.fill_null(0).to_numpy()
                info["null"] = part.is_null().to_numpy(zero_copy_only=False)
                info["n"] = n
                held.append((ids, info))
                size += len(ids)
                if size >= segment:
                    yield flush()
        if held:
            yield flush()

    dealt = src.repartitionByRange(files, F.col("doc_id").asc_nulls_first()) if files > 1 else src.coalesce(1)
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select(F.spark_partition_id().alias("file_no"), "doc_id", "text")
    arrow(dealt, run, SEGMENT, "tokens").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids as binary]) of each document of a token file."""
    seg = spark.read.schema(SEGMENT).parquet(path)
    totals = sorted((r["file_no"], r["n"]) for r in seg.groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect())  # a row a file
    begin, at = {}, 0
    for no, n in totals:
        begin[no], at = at, at + n
    held = spark.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                no, _, before, _, _, docs, blocks, planes = (b.column(c)[r].as_py() for c in range(8))
                info, ids = np.frombuffer(docs, dtype=_DOC), unpack(blocks, planes)
                end = np.cumsum(info["n"].astype(np.int64))
                first = end - info["n"]
                raw = memoryview(ids.astype("<u4").tobytes())
                parts = [raw[4 * a : 4 * z] for a, z in zip(first.tolist(), end.tolist(), strict=True)]
                cols = [
                    pa.array(info["doc_id"], pa.int64(), mask=info["null"].astype(bool)),
                    pa.array(held.value[no] + before + first),
                    pa.array(info["n"].astype(np.int64)),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow(seg, run, schema)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("file")
    write(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"))
    return read(spark, path)
