import numpy as np
import pyarrow as pa

from panelloom.llm import _text as T
from panelloom.llm import langid as L

EN = "the house and the garden of the king with a river that was in the north"
FR = "la maison et le jardin du roi avec une rivière qui était dans le nord"
ROWS = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (FR, "fr")] * 10)]
SCHEMA = "doc_id long, text string, lang string"


def test_mixture_and_edges(spark):
    model = L.fit(spark.createDataFrame(ROWS, SCHEMA))
    texts = [EN, FR, None, "", "123 ... 456", "— 。", (EN + " ") * 40 + (FR + " ") * 40, EN * 2000]
    docs = spark.createDataFrame([(i, t, "zz", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = {r["doc_id"]: r for r in L.mixtures(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["en", "fr", "und", "und", "und", "und"]
    assert 0.4 < got[6]["mixture"]["en"] < 0.6 and abs(sum(got[6]["mixture"].values()) - 1) < 1e-6
    assert set(got[7]["mixture"]) == {"en"}
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 6, 7]


def test_slices_do_not_matter():
    model = {"langs": ["a", "b"], "table": L.np.random.default_rng(0).normal(-9, 1, ((1 << L.BITS) + 1, 2)).astype("float32")}
    texts = pa.array([EN, None, FR * 3, "x", ""] * 7)
    one = [x.as_py() for x in L._predict(texts, model)[1]]
    each = []
    for t in texts:
        each += [x.as_py() for x in L._predict(pa.array([t.as_py()], pa.string()), model)[1]]
    assert all(abs(a - b) < 1e-9 for a, b in zip(one, each, strict=True))


def test_no_labels(spark):
    model = L.fit(spark.createDataFrame([(1, EN, None)], SCHEMA))
    docs = spark.createDataFrame([(1, EN), (2, "")], "doc_id long, text string")
    assert [r["lang_pred"] for r in L.mixtures(docs, model).collect()] == ["und", "und"]
    assert [r["doc_id"] for r in L.keep_identified(docs, model).collect()] == [1]


def _six():
    """Six languages with letters of their own, in which every trigram of another language is unlikely."""
    langs, table = [f"l{k}" for k in range(6)], L.np.full(((1 << L.BITS) + 1, 6), -14.0, L.np.float32)
    table[-1] = 0
    words = ["".join(chr(97 + 4 * k + (i + j) % 4) for j in range(6)) for k in range(6) for i in range(4)]
    words = [words[4 * k : 4 * k + 4] for k in range(6)]
    for k in range(6):
        data = L.np.frombuffer(" ".join(a + " " + b for a in words[k] for b in words[k]).encode(), L.np.uint8)
        bucket, counts, _ = L.grams(data, L.np.array([0, len(data)]))
        table[bucket[counts], k] = -5.0
    return {"langs": langs, "table": table}, [" ".join((words[k] * 100)[:320]) for k in range(6)]


def test_as_many_languages_as_a_text_has():
    model, texts = _six()
    for n in range(1, 7):
        mix = dict(L._predict(pa.array([" ".join(texts[:n])]), model)[3][0].as_py())
        assert set(mix) == set(model["langs"][:n]) and all(abs(x - 1 / n) < 0.01 for x in mix.values())


def test_batches_do_not_matter():
    """A text for which three languages beat one and two do not gets three, whatever stands beside it."""
    table = L.np.full(((1 << L.BITS) + 1, 5), -9.0, L.np.float32)
    table += L.np.random.default_rng(4).normal(0, 1.5, table.shape).astype(L.np.float32)
    table[-1] = 0
    model = {"langs": list("abcde"), "table": table}
    rng = L.np.random.default_rng(5)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 5))
    texts = [" ".join(word() for _ in range(int(rng.integers(1, 400)))) for _ in range(150)]
    many = L._predict(pa.array(texts), model)
    for i, t in enumerate(texts):
        one = L._predict(pa.array([t]), model)
        assert one[0][0] == many[0][i] and set(dict(one[3][0].as_py())) == set(dict(many[3][i].as_py())) and abs(one[1][0].as_py() - many[1][i].as_py()) < 1e-9


def plain_mixture(text, model, span=8, rounds=12, penalty=2.0):
    """The shares of one text by loops over its segments and letters."""
    import math

    langs = len(model["langs"])
    raw = (text + " ").encode()
    fold = [b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in raw]
    segs, words, two = [], 0, [32, 32]
    for k, c in enumerate(fold):
        before = fold[k - 1] if k else 32
        if c != 32 and before == 32:
            if words % span == 0:
                segs.append([[0.0] * langs, 0])
            words += 1
        if segs and (c != 32 or before != 32):
            key = (two[0] << 16 | two[1] << 8 | c) * 2654435761 % (1 << 32) >> (32 - L.BITS)
            row = model["table"][key]
            segs[-1] = [[a + float(b) for a, b in zip(segs[-1][0], row)], segs[-1][1] + 1]
        two = [two[1], c]
    if not segs:
        return [0.0] * langs

    def em(on, rounds):
        pi = [1 / len(on) if k in on else 0.0 for k in range(langs)]
        for r in range(rounds + 1):
            like, new = 0.0, [0.0] * langs
            for ll, w in segs:
                x = [ll[k] + math.log(pi[k]) if pi[k] > 0 else -math.inf for k in range(langs)]
                top = max(x)
                p = [math.exp(v - top) for v in x]
                like += top + math.log(sum(p))
                for k in range(langs):
                    new[k] += w * p[k] / sum(p)
            if r == rounds:
                return pi, like
            pi = [v / sum(w for _, w in segs) for v in new]

    pi, _ = em(set(range(langs)), rounds)
    rank = sorted(range(langs), key=lambda k: (-pi[k], k))
    price = penalty * math.log(sum(w for _, w in segs) + 1)
    best, score = em(set(rank[:1]), 0)
    for k in range(2, langs + 1):
        p, like = em(set(rank[:k]), rounds)
        if like - price * (k - 1) > score:
            best, score = p, like - price * (k - 1)
    return best


def many_languages(n):
    rng = np.random.default_rng(8)
    words = [["".join(chr(97 + (x + 3 * k) % 26) for x in rng.integers(0, 9, int(rng.integers(2, 7)))) for _ in range(150)] for k in range(n)]
    text = lambda k, n: " ".join(words[k][i] for i in rng.integers(0, 150, n))
    return words, text, rng


def test_plain_em_agrees_and_slices_and_order_do_not_matter(spark):
    _, text, rng = many_languages(8)
    rows = [(8 * i + k, text(k, 60), f"l{k}") for i in range(12) for k in range(8)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model["langs"]) == 8
    texts = [" ".join(text(int(k), 40) for k in rng.permutation(8)[: 1 + i % 8]) for i in range(24)] + ["", "12 34", "ab", text(3, 5)]
    whole = L.estimate(*T.buffers(pa.array(texts)), model)
    for t, got in zip(texts, whole, strict=True):
        assert np.allclose(got, plain_mixture(t, model), atol=1e-6), t
        assert np.allclose(got, L.estimate(*T.buffers(pa.array([t])), model)[0], atol=1e-12)
    order = rng.permutation(len(texts))
    assert np.allclose(L.estimate(*T.buffers(pa.array([texts[i] for i in order])), model), whole[order], atol=1e-12)


def test_six_languages_get_six_shares(spark):
    _, text, _ = many_languages(8)
    rows = [(8 * i + k, text(k, 60), f"l{k}") for i in range(12) for k in range(8)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = L.estimate(*T.buffers(pa.array([" ".join(text(k, 80) for k in range(6))])), model)[0]
    assert (np.abs(got[:6] - 1 / 6) < 0.03).all() and (got[6:] < 0.01).all()


def test_ties_go_to_the_language_that_sorts_first(spark):
    rows = [(1, "same words here", "b"), (2, "same words here", "a"), (3, None, "c")]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(9, "same words")], "doc_id long, text string")
    assert L.mixtures(docs, {"langs": model["langs"][:2], "table": np.ascontiguousarray(model["table"][:, :2])}).first()["lang_pred"] == "a"
    assert L.mixtures(docs.limit(0), model).count() == 0 and L.keep_identified(docs.limit(0), model).count() == 0
