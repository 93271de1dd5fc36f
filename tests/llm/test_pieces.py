import numpy as np
import pytest

from panelloom.llm.pieces import ChunkStore


@pytest.mark.parametrize("most", [1, 7, 30, 10_000])
def test_store_of_any_size_gives_the_same_ids(most):
    rng = np.random.default_rng(most)
    store = ChunkStore(lambda chunks: [[b % 50 for b in c if b != 99] for c in chunks], most)
    for _ in range(30):
        words = [bytes(rng.integers(97, 102, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(0, 40)))]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        end = np.cumsum([len(w) for w in words]).astype(np.int64) if words else np.zeros(0, np.int64)
        start = end - np.array([len(w) for w in words], dtype=np.int64)
        ids, size = store.encode_spans(data, start, end)
        want = [[b % 50 for b in w if b != 99] for w in words]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == [v for x in want for v in x]
        assert len(store.keys) <= max(most, 40)


def thue_morse(n, a, b):
    text = a
    while len(text) < n:
        text += text.translate(str.maketrans(a + b, b + a))
    return text


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_of_one_hash_keep_their_own_ids(n):
    from panelloom.llm import _text as T

    x, y = thue_morse(n, "a", "b").encode(), thue_morse(n, "b", "a").encode()
    data = np.frombuffer(x + y + x, dtype=np.uint8)
    start, end = np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])
    assert n < 2048 or len(set(T.span_hashes(data, start, end).tolist())) == 1
    encode = lambda chunks: [list(c) for c in chunks]
    ids, size = ChunkStore(encode).encode_spans(data, start, end)
    assert bytes(ids.tolist()) == data.tobytes() and size.tolist() == [n] * 3
    store = ChunkStore(encode)
    for _ in range(2):
        for raw in (x, y, x + y):
            ids, _ = store.encode_spans(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
            assert bytes(ids.tolist()) == raw


def test_store_is_bounded_in_bytes():
    store = ChunkStore(lambda chunks: [list(c) for c in chunks], most_bytes=50)
    for k in range(20):
        ids, _ = store.encode_spans(np.full(30, k, np.uint8), np.array([0]), np.array([30]))
        assert ids.tolist() == [k] * 30 and store.at[-1] <= 50


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_op4_and_op7_encode_texts_of_one_hash_as_the_libraries_do(spark, order):
    import sentencepiece
    from tokenizers import Tokenizer

    from panelloom.llm import token_file, transducer

    texts = [x for n in (1024, 2048, 4096) for x in (thue_morse(n, "a", "b"), thue_morse(n, "b", "a"))]
    texts = [texts[2 * (k // 2) + order[k % 2]] for k in range(len(texts))]
    t = Tokenizer.from_file(token_file.public_path("byte_bpe_50k.json"))
    path = token_file.public_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for group in (texts, *([x] for x in texts)):  # in one batch and one by one
        from panelloom.llm import _text as T
        import pyarrow as pa

        data, off = T.buffers(pa.array(group, pa.string()))
        ids, n = token_file.encode_texts(data, off, token_file.public_path("byte_bpe_50k.json"), 2)
        assert ids.tolist() == [i for x in group for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
        ids, n = transducer.codec(path).encode(data, off)
        assert ids.tolist() == [i for x in group for i in sp.encode(x)]


def test_spans_are_compared_byte_by_byte():
    from panelloom.llm import pieces

    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, 5000).astype(np.uint8)
    y = x.copy()
    y[rng.integers(0, 4900, 60)] = 9
    start = rng.integers(0, 4000, 800)
    size = np.where(rng.random(800) < 0.1, rng.integers(200, 900, 800), rng.integers(0, 30, 800))
    got = pieces.differing(x, start, y, start, size)
    assert got.tolist() == [bool((x[a : a + n] != y[a : a + n]).any()) for a, n in zip(start, size)] and 50 < got.sum() < 700
