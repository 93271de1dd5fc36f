"""Telephony audio columns: mu-law and A-law by lookup tables, ADPCM blocks decoded across blocks, resampled PCM.

`to_wav` stores a payload losslessly as 8-bit mu-law samples in a RIFF/WAVE file (format tag 7, 8 kHz, mono); `payload_of`
reads the samples back. `expand` turns companded samples into 16-bit PCM through a 256-entry table, `decode_adpcm` decodes IMA
ADPCM blocks, all blocks of a batch in step (`encode_adpcm` makes them), and `resample` doubles the rate by linear interpolation.
`resampled` gives the PCM as WAVE files to store; the digest query keeps the crc32 of it only (README: its size).

Payloads of the digest query are a text's UTF-8 bytes (null: empty) with zero bytes up to a positive multiple of 64. Equal
payloads have equal results. Null and empty texts give a payload of 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import Scratch, arrow, table

PAD = 64
MU_LAW, A_LAW, PCM = 7, 6, 1


def _mu_table() -> np.ndarray:
    c = ~np.arange(256) & 255
    mag = (((c & 15) << 3) + 132 << ((c >> 4) & 7)) - 132
    return np.where(c & 128, -mag, mag).astype(np.int16)


def _a_table() -> np.ndarray:
    c = np.arange(256) ^ 0x55
    exp, man = (c >> 4) & 7, (c & 15) << 4
    mag = np.where(exp == 0, man + 8, (man + 264) << np.maximum(exp - 1, 0))
    return np.where(c & 128, mag, -mag).astype(np.int16)


MU, A = _mu_table(), _a_table()

# The 89 step sizes of IMA ADPCM, by rule but for the rounding of the published table: fixed values.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)  # fixed values: step changes of IMA ADPCM


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """For (step index, nibble): the change of the sample, and the next step index."""
    step, n = STEPS[:, None], np.arange(16)[None, :]
    diff = (step >> 3) + (n >> 2 & 1) * step + (n >> 1 & 1) * (step >> 1) + (n & 1) * (step >> 2)
    return np.where(n & 8, -diff, diff).astype(np.int32).ravel(), np.clip(np.arange(89)[:, None] + INDEX[n], 0, 88).astype(np.int32).ravel() * 16


_DIFF, _NEXT = _moves()


def expand(samples: np.ndarray, law: int = MU_LAW) -> np.ndarray:
    return (MU if law == MU_LAW else A)[samples]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 (blocks, samples) of IMA ADPCM blocks (blocks, bytes): a header of sample (int16), step index, a spare byte,
    then two nibbles a byte, low first. Step indexes over 88 count as 88."""
    head = blocks[:, :4]
    last = (head[:, 0].astype(np.int32) | head[:, 1].astype(np.int32) << 8) << 16 >> 16
    at = np.minimum(head[:, 2], 88).astype(np.int32) * 16
    nibbles = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(nibbles), len(blocks)), dtype=np.int16)
    out[0] = last
    for k, byte in enumerate(nibbles):
        for half, n in enumerate((byte & 15, byte >> 4)):
            key = at + n
            last = np.clip(last + _DIFF[key], -32768, 32767)
            at = _NEXT[key]
            out[1 + 2 * k + half] = last
    return np.ascontiguousarray(out.T)


def encode_adpcm(pcm: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (blocks, bytes) of int16 (blocks, samples), all blocks in step; an odd number of samples. The first sample
    and step index 0 are the header."""
    x = np.ascontiguousarray(pcm.T).astype(np.int32)
    last, at = x[0].copy(), np.zeros(x.shape[1], np.int32)
    out = np.zeros((4 + (len(x) - 1) // 2, x.shape[1]), dtype=np.uint8)
    out[0], out[1] = last & 255, last >> 8 & 255
    for k in range(1, len(x)):
        step, d = STEPS[at >> 4], x[k] - last
        n, d = np.where(d < 0, 8, 0), np.abs(d)
        for bit in (4, 2, 1):
            on = d >= step
            n, d, step = n + bit * on, d - step * on, step >> 1
        key = at + n
        last, at = np.clip(last + _DIFF[key], -32768, 32767), _NEXT[key]
        out[4 + (k - 1) // 2] |= (n << (4 * ((k - 1) & 1))).astype(np.uint8)
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample and the mean (towards minus infinity) of it and the next; the last one twice."""
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    if len(pcm):
        out[-1] = pcm[-1]
    return out


def wav(data: bytes, tag: int, rate: int, bits: int) -> bytes:
    body = data + b"\0" * (len(data) & 1)
    fmt = struct.pack("<4sIHHIIHHH", b"fmt ", 18, tag, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(data) * 8 // bits)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(fact) + 8 + len(body), b"WAVE") + fmt + fact + struct.pack("<4sI", b"data", len(data)) + body


def to_wav(payload: bytes, law: int = MU_LAW, rate: int = 8000) -> bytes:
    return wav(payload, law, rate, 8)


def pcm_wav(pcm: np.ndarray, rate: int = 16000) -> bytes:
    return wav(pcm.astype("<i2").tobytes(), PCM, rate, 16)


def payload_of(media: bytes) -> tuple[bytes, int]:
    """(samples, format tag) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return media[at + 8 : at + 8 + n], tag
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def store(docs: DataFrame, law: int = MU_LAW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a WAVE file."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in T.slices(b.column(1)):
                raw = data.tobytes()
                media = [to_wav(padded(raw[a:z]), law) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return arrow(src, run, "doc_id long, n_bytes long, media binary")


BLOCK = 65  # samples of an ADPCM block in the features: a header and 32 bytes


def _features(parts: list[bytes], tags: list[int]) -> list[str]:
    """Of each payload: mean square and zero crossings of its expansion, mean square of the samples read by the other law, mean
    square error of its samples once coded as ADPCM blocks and decoded, and the crc32 of its resampled PCM."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size)
    start = end - size
    a_law = np.repeat(np.array(tags) == A_LAW, size)
    pcm, other = np.where(a_law, A[data], MU[data]), np.where(a_law, MU[data], A[data])
    mean = lambda x: T.reduce_sum(x.astype(np.int64) ** 2, start, end) // np.maximum(size, 1)
    power, crossed = mean(pcm), mean(other)
    flip = np.concatenate(((pcm[1:] < 0) != (pcm[:-1] < 0), [False]))
    flip[end - 1] = False
    cross = T.reduce_sum(flip, start, end, np.int64)
    # ADPCM: the blocks of all payloads in step; a last short block is padded with zeros.
    n_blocks = -(-size // BLOCK)
    grid = np.zeros((int(n_blocks.sum()), BLOCK), dtype=np.int16)
    at = np.cumsum(n_blocks) - n_blocks
    place = T.ranges(at * BLOCK, size)
    grid.reshape(-1)[place] = pcm
    error = mean(decode_adpcm(encode_adpcm(grid)).reshape(-1)[place].astype(np.int32) - pcm)
    out = []
    for k, (a, z) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        crc = zlib.crc32(resample(pcm[a:z]).astype("<i2").tobytes())
        out.append(f"power={power[k]};crossings={cross[k]};other_law={crossed[k]};adpcm_error={error[k]};pcm16k={crc:08x}")
    return out


def read_back(stored: DataFrame) -> DataFrame:
    """The digest of stored media: payload and media hashes, and features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in T.slices(b.column(2), 1 << 21):
                raw = data.tobytes()
                media = [raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                got = [payload_of(m) for m in media]
                parts = [p for p, _ in got]
                cols = [
                    b.column(0).slice(first, end - first),
                    b.column(1).slice(first, end - first),
                    pa.array([len(p) for p in parts], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
                    pa.array([zlib.crc32(p[-PAD:]) for p in parts], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array(_features(parts, [t for _, t in got])),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow(stored.select("doc_id", "n_bytes", "media"), run, schema)


def resampled(stored: DataFrame) -> DataFrame:
    """`stored` as (doc_id, pcm): the samples expanded by their file's law, at twice the rate, as 16-bit PCM WAVE files (null
    media: null). The result is for writing: four bytes a payload byte before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in T.slices(b.column(1), 1 << 21):
                raw, pcm = data.tobytes(), []
                for k, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    if not b.column(1)[first + k].is_valid:
                        pcm.append(None)
                        continue
                    samples, tag = payload_of(raw[a:z])
                    pcm.append(pcm_wav(resample(expand(np.frombuffer(samples, dtype=np.uint8), tag))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(pcm, pa.binary())], names=["doc_id", "pcm"])

    return arrow(stored.select("doc_id", "media"), run, "doc_id long, pcm binary")


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = Scratch(spark, "media").keep(store(table(spark, sf_dir, "documents")), "wav")
    return read_back(media)
