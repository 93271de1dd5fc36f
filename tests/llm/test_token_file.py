import zlib

import numpy as np
import pytest

from panelloom.llm import token_file as K
from panelloom.llm._common import Scratch

TEXTS = [
    "a  b\n\n c　 d  e 's it's <|endoftext|> x\t y",
    "",
    None,
    "é à ü   z \n\n",
    " lead",
    " \n",
    "漢字 かな",
    "x\u0085 y",
    "\U0001f600 ok ​  w",
    "word " * 40000,
    "same text",
    "same text",
]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 20, n).astype(np.uint32)
    assert (K.unpack(*K.pack(ids, 64, planes)) == ids).all()


@pytest.mark.parametrize("per_file", [16000, 3])
def test_file_matches_library(spark, per_file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.public_path("byte_bpe_50k.json"))
    rows = [(7 * i % 100, x) for i, x in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, start int")
    path = Scratch(spark, "test").path("tokens")
    K.write(docs, path, K.public_path("byte_bpe_50k.json"), segment=500, block=128, docs_per_file=per_file)
    got = sorted(K.read(spark, path).collect())
    at = 0
    for r, (i, x) in zip(got, sorted(rows), strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_and_null_ids(spark):
    path = Scratch(spark, "test").path("tokens")
    K.write(spark.createDataFrame([], "doc_id long, text string"), path, K.public_path("byte_bpe_50k.json"))
    assert K.read(spark, path).count() == 0
    path = Scratch(spark, "test").path("tokens")
    K.write(spark.createDataFrame([(1, "b"), (None, "a"), (1, "b")], "doc_id long, text string"), path, K.public_path("byte_bpe_50k.json"))
    assert [(r["doc_id"], r["start"]) for r in sorted(K.read(spark, path).collect(), key=lambda r: r["start"])] == [(None, 0), (1, 2), (1, 4)]


def test_chunks_are_joined_where_no_token_reaches_over():
    """All chunks of the texts, in any order, as texts of many and one by one; far fewer texts than chunks are encoded."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from panelloom.llm import _text as T
    from panelloom.llm.pieces import spans_of

    path = K.public_path("byte_bpe_50k.json")
    t, rng = Tokenizer.from_file(path), np.random.default_rng(2)
    alphabet = list("ab1'. \n\t\u3000\u0085é漢\U0001f600") + ["<|endoftext|>", "'s", "  "]
    texts = [*TEXTS, *("".join(rng.choice(alphabet, 60)) for _ in range(200)), " ".join(f"word{i}" for i in range(20_000))]
    data, off = T.buffers(pa.array(texts, pa.string()))
    start, end, _, _ = spans_of(data, off, T.chunk_cuts(data))
    order, seen = rng.permutation(len(start)), []

    def encode(parts):
        seen.extend(parts)
        return [e.ids for e in t.encode_batch_fast(parts, add_special_tokens=False)]

    ids, n = K.join(encode, K.byte_lengths(t.to_str()))(data, start[order], (end - start)[order])
    want = [t.encode(data[start[k] : end[k]].tobytes().decode(), add_special_tokens=False).ids for k in order]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(seen) < len(order) / 5
    store = K._store(path)
    assert store.joined is not None


def test_other_tokenizers_are_encoded_one_by_one():
    import json

    t = json.load(open(K.public_path("byte_bpe_50k.json")))
    assert K.byte_lengths(json.dumps(t)) is not None
    for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**t["pre_tokenizer"], "add_prefix_space": True}}):
        assert K.byte_lengths(json.dumps({**t, **change})) is None
    assert K.join(lambda texts: [[0] for _ in texts], np.ones(1, np.int64))(np.frombuffer(b"a bc", np.uint8), np.array([0, 1]), np.array([1, 3])) is None
