import hashlib
import wave
import zlib
from io import BytesIO

import numpy as np

from panelloom.llm import telephony as P


def test_tables():
    # Fixed points of the two laws.
    assert P.MU[0xFF] == 0 and P.MU[0x7F] == 0 and P.MU[0x80] == 32124 and P.MU[0x00] == -32124
    assert P.A[0xD5] == 8 and P.A[0x55] == -8 and P.A[0xAA] == 32256 and P.A[0x2A] == -32256
    assert len(set(P.A.tolist())) == 256 and len(set(P.MU.tolist())) == 255


def adpcm_one(block):
    last = int.from_bytes(block[:2].tobytes(), "little", signed=True)
    index, out = min(int(block[2]), 88), [last]
    for byte in block[4:]:
        for n in (int(byte) & 15, int(byte) >> 4):
            step = int(P.STEPS[index])
            d = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            last = max(-32768, min(32767, last - d if n & 8 else last + d))
            index = max(0, min(88, index + int(P.INDEX[n])))
            out.append(last)
    return out


def test_adpcm_across_blocks():
    blocks = np.random.default_rng(0).integers(0, 256, (40, 64), dtype=np.uint8)
    assert P.decode_adpcm(blocks).tolist() == [adpcm_one(b) for b in blocks]


def test_round_trip(spark):
    texts = [None, "", "é" * 32, "x" * 64, "y" * 65, "long " * 30000, "y" * 65]
    docs = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r["doc_id"]: r for r in P.read_back(P.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(pay[-64:]) and r["media_bytes"] == len(P.to_wav(pay))
        assert f"pcm16k={zlib.crc32(P.resample(P.MU[np.frombuffer(pay, np.uint8)]).tobytes()):08x}" in r["feature"]
    assert got[4][3:] == got[6][3:] and got[0]["feature"] == got[1]["feature"]
    pcm = {r["doc_id"]: r["pcm"] for r in P.resampled(P.store(docs)).collect()}
    with wave.open(BytesIO(bytes(pcm[3]))) as w:
        assert (w.getframerate(), w.getsampwidth(), w.getnframes()) == (16000, 2, 128)
    assert P.read_back(P.store(docs.limit(0))).count() == 0


def test_encoded_blocks_decode_to_nearly_their_samples():
    t = np.arange(65 * 30)
    pcm = (8000 * np.sin(t / 7) + 2000 * np.sin(t / 3)).astype(np.int16).reshape(30, 65)
    blocks = P.encode_adpcm(pcm)
    back = P.decode_adpcm(blocks).astype(int)
    assert blocks.shape == (30, 36) and [adpcm_one(b) for b in blocks] == back.tolist()
    assert (back[:, 0] == pcm[:, 0]).all() and np.abs(back - pcm)[:, 30:].mean() < 400
    assert (P.decode_adpcm(P.encode_adpcm(np.zeros((3, 65), np.int16))) == 0).all() and P.encode_adpcm(np.zeros((0, 65), np.int16)).shape == (0, 36)


def test_features_against_loops(spark):
    texts = ["", "Some text, with é and 123.", "x" * 500, "ab" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for law, mine, other in ((P.MU_LAW, P.MU, P.A), (P.A_LAW, P.A, P.MU)):
        stored = P.store(docs, law)
        pcm = {r["doc_id"]: bytes(r["pcm"]) for r in P.resampled(stored).collect()}
        for r in P.read_back(stored).collect():
            pay = P.padded(texts[r["doc_id"]].encode())
            x = [int(mine[b]) for b in pay]
            error = 0
            for k in range(0, len(x), P.BLOCK):
                part = np.array([x[k : k + P.BLOCK] + [0] * (P.BLOCK - len(x[k : k + P.BLOCK]))], np.int16)
                error += sum((a - b) ** 2 for a, b in zip(adpcm_one(P.encode_adpcm(part)[0]), x[k : k + P.BLOCK]))
            got = dict(p.split("=") for p in r["feature"].split(";"))
            assert int(got["power"]) == sum(v * v for v in x) // len(x) and int(got["other_law"]) == sum(int(other[b]) ** 2 for b in pay) // len(x)
            assert int(got["crossings"]) == sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) and int(got["adpcm_error"]) == error // len(x)
            with wave.open(BytesIO(pcm[r["doc_id"]])) as w:
                assert f"{zlib.crc32(w.readframes(w.getnframes())):08x}" == got["pcm16k"]
            assert r["payload_sha256"] == hashlib.sha256(pay).hexdigest()


def test_null_media_have_null_pcm(spark):
    assert P.resampled(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()["pcm"] is None
