import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from panelloom.llm import _text as T
from panelloom.llm import simhash as S
from panelloom.llm._common import Scratch


def brute_code(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(codes):
    ids = list(range(len(codes)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


TEXTS = ["", None, " \n\t", "one", "Two Words", "a\tb\x0cc  d", "é É x ß", "w" * 5000, " ".join(["aa bb"] * 700), "x " * 3]


def test_codes_match_xxhash():
    got = [int(x) for _, _, d, o in T.slices(pa.array(TEXTS)) for x in S.codes(d, o)]
    assert got == [brute_code(t) for t in TEXTS]


def test_index_finds_all_links():
    rng = np.random.default_rng(1)
    c = [int(x) for x in rng.integers(0, 2**63, 120, dtype=np.uint64)]
    c += [x ^ (1 << int(a)) ^ (1 << int(b)) for x in c[:80] for a, b in [rng.integers(0, 64, 2)]]
    c = np.unique(np.array(c, dtype=np.uint64))
    index = S.GrayIndex(c, np.zeros(len(c), np.int64))
    got = {frozenset((int(index.code[a]), int(index.code[b]))) for i, j in index.pairs(2, 50) for a, b in zip(i, j, strict=True)}
    assert got == {frozenset((int(x), int(y))) for x in c for y in c if x < y and bin(int(x) ^ int(y)).count("1") <= 2}


@pytest.mark.parametrize("bucket", [4096, 64])
def test_components_match_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    c = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    for x in c[:20]:
        for _ in range(3):
            x ^= 1 << int(rng.integers(0, 64))
            c.append(x)
    for _ in range(120):
        c.append(c[0] ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
    rows = [(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(c)]
    reps = spark.createDataFrame(rows, "rep long, fp long").groupBy("fp").agg({"rep": "min"}).withColumnRenamed("min(rep)", "rep")
    scratch = Scratch(spark, "test")
    comp = S.components(S.linked_codes(reps, scratch, 2, bucket), scratch)
    got = {r["node"]: r["component"] for r in comp.collect()}
    assert [got.get(c.index(x), c.index(x)) for x in c] == brute_components(c)


def test_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "one", "x"), (None, "one", "x"), (77, "Two  words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = S.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[0]["component_id"] == by[1]["component_id"] == by[2]["component_id"] == 0
    assert by[0]["fingerprint"] == "0" * 16
    assert by[77]["component_id"] == 4
    assert S.near_duplicates(docs.limit(0)).count() == 0
