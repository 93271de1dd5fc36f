import pytest

from panelloom.llm import decontaminate as D

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [
    (1, "x " * 3000 + ITEM.upper().replace(" ", ", ") + " y" * 3000),
    (2, ITEM[:-20]),
    (3, None),
    (4, ""),
    (5, "nothing of the kind"),
    (6, "and a Tiny Item, here"),
    (None, "a " + ITEM),
    (1, "clean"),
]
ITEMS = [(10, ITEM), (11, "tiny item"), (12, ""), (13, None), (14, "ÉCOLE d'été")]


def brute(docs, items):
    out = []
    for d, t in docs:
        w = D.words_of(t)
        for i, x in items:
            v = D.words_of(x)
            if v:
                n = min(5, len(v))
                a, b = D.shingles_of(v, n), D.shingles_of(w, n)
                if len(a & b) >= 0.8 * len(a):
                    out.append((d, i, len(a), len(a & b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [4 << 20, 60])
def test_matches_brute_force(spark, bound):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumnRenamed("x", "y")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.contained_items(docs, items, max_items_bytes=bound)
    got = sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_common"]) for r in out.collect()), key=str)
    assert got == brute(DOCS, ITEMS)
    assert {(1, 10), (6, 11), (None, 10)} <= {x[:2] for x in got}
    kept = D.decontaminate(docs, items, max_items_bytes=bound).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] and r["text"]) == [(1, "clean"), (2, ITEM[:-20]), (5, "nothing of the kind")]
    assert len(kept) == 5


def test_hash_ways_agree():
    import pyarrow as pa

    from panelloom.llm import _text as T

    texts = ["Ébc DEF x", "Ωmega σΣ", "漢字 test", "İstanbul", "plain text", "", "áb ²"]
    for t in texts + [" ".join(texts)]:
        h, lo, hi = D.word_hashes(*T.buffers(pa.array([t, "Plain"])))
        assert [int(x) for x in D.shingle_hashes(h, 1)[lo[0] : hi[0]]] == [D.hash_shingle((w,)) for w in D.words_of(t)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(docs, items).count() == 0
    assert D.decontaminate(docs, items).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_sketches_find_every_contained_item(threshold):
    """Items of 1 to 400 words, repeats included, planted in part into long texts."""
    import numpy as np
    import pyarrow as pa

    from panelloom.llm import _text as T

    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 300, n)]
    items = [(i, " ".join(word(int(n)))) for i, n in enumerate(np.concatenate((np.arange(1, 40), rng.integers(40, 400, 20))))]
    items += [(900, "la " * 50), (901, ""), (902, None), (0, items[20][1])]
    docs = []
    for i, t in items:
        w = (t or "").split()
        for share in (0.45, 0.7, 0.79, 0.8, 0.85, 1.0):
            n = int(len(w) * share)
            docs.append((len(docs), " ".join(word(200) + w[:n] + ["zz"] + w[n + 2 :] * (share > 0.75) + word(200))))
    sketches = D.Sketches(items, 5, threshold)
    data, off = T.buffers(pa.array([t for _, t in docs]))
    found = sketches.candidates(data, off)
    got = sorted((d, *x) for d, its in found.items() for x in sketches.verify(docs[d][1], its))
    want = []
    for d, t in docs:
        w = D.words_of(t)
        for i, x in items:
            v = D.words_of(x)
            if v:
                n = min(5, len(v))
                a, b = D.shingles_of(v, n), D.shingles_of(w, n)
                if len(a & b) >= threshold * len(a) - 1e-9:
                    want.append((d, i, len(a), len(a & b)))
    assert got == sorted(want) and len(want) > 100


def test_partitions_bound_their_items():
    import numpy as np

    n = np.arange(1, 5000)
    top = D.partition_of(n)
    assert (top >= n).all() and (top <= n * D.STEP_UP + 1).all() and len(np.unique(top)) < 60
    assert (np.diff(top) >= 0).all()
    assert D.sketch_length(np.array([1, 5, 20, 100]), 0.8).tolist() == [1, 2, 5, 21]


def test_many_items_are_sketched_in_short_time():
    import time

    items = [(i, " ".join(f"w{(i * 7919 + k * 104729) % 50021}" for k in range(60))) for i in range(20_000)]
    began = time.perf_counter()
    sketches = D.Sketches(items, 5, 0.8)
    assert time.perf_counter() - began < 20 and len(sketches.by[5][0]) > 10_000
