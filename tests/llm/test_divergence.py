import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelloom.llm import divergence as D
from panelloom.llm._common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int"


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        at = [i for i, r in enumerate(rows) if r[1] == lang]
        docs = Counter(w for i in at for w in set(words[i]))
        kept = sorted(w for w, n in docs.items() if n >= min_docs)
        count = lambda own: Counter(w for i in own for w in words[i] if docs[w] >= min_docs)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q = share(count(at))
        sources = sorted({rows[i][2] for i in at})
        counts = {s: count([i for i in at if rows[i][2] == s]) for s in sources}
        p = {s: share(c) for s, c in counts.items()}
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def audit(spark, rows, **more):
    df = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in D.audit(df, **more).collect())


def texts(rng, n):
    vocab = ["a", "B", "b", "Zürich", "zürich", "É", "é", "日本", "x-y", "don't", "🎉", "word"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    return [(" ".join(rng.choice(vocab, rng.integers(0, 30))), str(rng.choice(["en", "de"])), f"s{min(int(rng.integers(0, 9)), 5)}") for _ in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "CELLS", 40)
    rows = texts(np.random.default_rng(1), 250)
    rows += [(None, "en", "s1"), ("", None, None), ("only here", "fr", None), ("é" * 20_000 + " word", "en", "s2"), (None, "", "void"), ("1 2 3 _", "en", "digits")]
    assert audit(spark, rows, min_docs=8, top=5) == brute(rows, 8, 5)
    assert audit(spark, rows, min_docs=30, top=50) == brute(rows, 30, 50)


def test_repeats_and_empty(spark):
    rows = [("one two two", "en", "a")] * 5 + [("two three", "en", "b")] * 3
    assert audit(spark, rows, min_docs=3) == brute(rows, 3, 50)
    assert audit(spark, rows, min_docs=9) == brute(rows, 9, 50)  # no kept terms: pairs of value 0
    assert audit(spark, []) == []


def test_ties_by_bytes(spark, monkeypatch):
    """Thousands of equal values: the bytes of the terms decide."""
    monkeypatch.setattr(D, "FEW", 8)
    rng = np.random.default_rng(2)
    items = sorted({"".join(rng.choice(list("abé日\U0001f389"), rng.integers(1, 7))) for _ in range(900)})
    rows = [("g", w, 7 if k % 3 else 7 + k % 5) for k, w in enumerate(items)] + [("h", w, 0) for w in items[:40]] + [("one", "x", 5)]
    df = spark.createDataFrame(rows, "g string, item string, v long").repartition(4)
    got = sorted(tuple(r) for r in D.radix_top(df, ["g"], "v", "item", 50, 30, Scratch(spark, "radix")).select("g", "item", "v", "rank").collect())
    want = []
    for g in ("g", "h", "one"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:50]
        want += [(*r, k + 1) for k, r in enumerate(own)]
    assert got == sorted(want)


def test_radix_equals_window(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 4)), f"i{k}", int(rng.integers(0, 1 << 30)) if k % 2 else int(rng.integers(0, 5))) for k in range(2000)]
    df = spark.createDataFrame(rows, "g int, item string, v long")
    got = D.radix_top(df, ["g"], "v", "item", 30, 30, Scratch(spark, "radix"))
    from pyspark.sql import Window

    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "item"))).where("rank <= 30")
    assert sorted(map(tuple, got.select("g", "item", "v", "rank").collect())) == sorted(map(tuple, want.select("g", "item", "v", "rank").collect()))


def test_tiles_equal_dense_sums():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 50, 11)
    dense = np.repeat(base[:, None], 40, axis=1)
    no, term = np.nonzero(rng.random((11, 40)) < 0.3)
    p = rng.integers(1, 400, len(no))
    dense[no, term] = p
    want = np.abs(dense[:, None, :] - dense[None, :, :]).sum(2) - 40 * np.abs(base[:, None] - base[None, :])
    for tile in (3, 11, 64):
        got = np.zeros((11, 11), np.int64)
        for a, b, m in D.bucket_sums(no, term, p, base, tile):
            got[a : a + tile, b : b + tile] = m
        assert (np.triu(got, 1) == np.triu(want, 1)).all()
