import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.llm import _text as T
from panelloom.llm import transducer as K
from panelloom.llm.token_file import public_path

PATH = public_path("piece_bpe_32k.model")
TEXTS = ["  Hello  world\n\tx ", "", None, "a" * 300, " " * 40 + "x" + " " * 17, "漢字 ①é▁ b▁▁ c", "x▁ y", "\U0001f600​ z", "word " * 5000, "same", "same"]


def encode(text):
    return K.codec(PATH).encode(*T.buffers(K.pa.array([text], K.pa.string())))[0].tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aehtinors ▁\né漢x0", max_size=40))
def test_shortest_path_is_the_library(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert encode(text) == sp.encode(text)


def test_query_round_trips(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_ids int")
    got = {r["doc_id"]: r["ids"] for r in K.encode(docs, PATH).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [sp.encode(t or "") for t in TEXTS]
    back = {r["doc_id"]: r["text"] for r in K.decode(K.encode(docs, PATH), PATH).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [(t or "").replace("▁", " ") for t in TEXTS]
    trips = {r["doc_id"]: r for r in K.round_trips(docs, PATH).collect()}
    assert [trips[i]["round_trip"] for i in range(len(TEXTS))] == ["▁" not in (t or "") for t in TEXTS]
    assert K.encode(docs.limit(0), PATH).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(no, value):
    return varint(no << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(no << 3) + varint(value)


def model_file(pieces, kind, charsmap=b"", prefix=1, squeeze=0):
    """A model file: pieces (text, score, kind); kind 1 unigram, 2 merges."""
    out = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, kind) + (field(35, 1) if any(k == K.BYTE for _, _, k in pieces) else b""))
    return out + field(3, field(1, b"own") + field(2, charsmap) + field(3, prefix) + field(4, squeeze))


def nmt_rules():
    spec = dict(K._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    return dict(K._fields(spec))[2]


def merge_pieces():
    with open(PATH, "rb") as f:
        m = K.Model(f.read())
    return list(zip(m.pieces, m.scores, m.kinds, strict=True))


def random_texts(n, seed=1):
    rng = np.random.default_rng(seed)
    odd = list("  \t\n\r\u00a0\u3000\u200b\ufeff\u00ad①ﬁﾃﾞﾊﾟ½²ＡＢ㌔한글e\u0301o\u0308ｶﾞ…»«—漢字ß▁İΣς٣\u0344\U0001f600")
    words = ["the", "House", "été", "straße", "3.14", "don't", "x", "river", "ing"]
    return ["".join(words[rng.integers(len(words))] if rng.random() < 0.5 else odd[rng.integers(len(odd))] * int(rng.integers(1, 3)) for _ in range(rng.integers(0, 14))) for _ in range(n)]


def same_as_library(raw, texts):
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), K.Codec(raw)
    ids, n = codec.encode(*T.buffers(K.pa.array(texts, K.pa.string())))
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    want = sp.encode(texts)
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    back = [codec.decode(np.array(g, np.int64)) for g in got]
    assert back == sp.decode(want)


@pytest.mark.parametrize("prefix, squeeze", [(1, 1), (0, 1), (1, 0), (0, 0)])
def test_rules_and_white_space_as_the_library(prefix, squeeze):
    same_as_library(model_file(merge_pieces(), 2, nmt_rules(), prefix, squeeze), random_texts(10_000 if prefix and squeeze else 1500) + ["", " ", "\u3000 ", "\t a \n"])


def test_squeezing_without_rules_as_the_library():
    same_as_library(model_file(merge_pieces(), 2, b"", 1, 1), random_texts(1500, 2) + ["   ", " a  b "])


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_unigram_as_the_library(byte_pieces):
    """Random scores; characters that are no piece are bytes or unknown."""
    rng = np.random.default_rng(4)
    pieces = [(p, float(-rng.uniform(2, 14)), k) for p, _, k in merge_pieces() if byte_pieces or k != K.BYTE]
    pieces = [x for k, x in enumerate(pieces) if x[2] != K.NORMAL or k % 3]
    if not byte_pieces:
        pieces.append(("▁", -9.5, K.NORMAL)) if "▁" not in {p for p, _, _ in pieces} else None
    raw, texts = model_file(pieces, 1, nmt_rules(), 1, 1), random_texts(3000, 3)
    sp, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), K.Codec(raw)
    ids, n = codec.encode(*T.buffers(K.pa.array(texts, K.pa.string())))
    cost = lambda ids: sum(-pieces[i][1] for i in ids if pieces[i][2] == K.NORMAL)
    same = 0
    for got, want in zip(np.split(ids, np.cumsum(n)[:-1]), sp.encode(texts), strict=True):
        got = got.tolist()
        same += got == want  # the same pieces in another order weigh the same, but for float32 rounding
        assert sorted(got) == sorted(want) and abs(cost(got) - cost(want)) < 1e-6
        assert codec.decode(np.array(got, np.int64)) == sp.decode(want)
    assert same > 2950


def test_rules_are_the_library_s():
    rules = K.char_rules(nmt_rules())
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    keys = [k for k in sorted(rules) if rules[k].strip() and "  " not in rules[k]][::7]
    assert len(rules) > 5000 and ["▁" + rules[k].replace(" ", "▁").lstrip("▁") for k in keys] == [n.normalize(k) for k in keys]


def test_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, encode("a b"))], "doc_id long, ids array<int>")
    assert [tuple(r) for r in K.decode(df, PATH).orderBy("doc_id").collect()] == [(1, None), (2, ""), (3, "a b")]


def test_unigram_weights():
    model = K.Model.__new__(K.Model)
    model.pieces, model.scores, model.kind = ["<unk>", "a", "b", "ab", "bc", "c"], [0, -1.0, -1.0, -2.5, -0.5, -1.0], 1
    model.id_of = {p: i for i, p in enumerate(model.pieces) if i}
    model.byte_id, model.unknown, model.kinds = {}, 0, [K.NORMAL] * 6
    assert K.Transducer(model).shortest("abc") == [1, 4]
    assert K.Transducer(model).shortest("axb") == [1, 0, 2]
