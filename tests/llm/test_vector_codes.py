import hashlib
import math

import numpy as np
import pytest

from panelloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, __n int"


def brute(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label). Returns [(id, label, code, error)], the codebooks."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max((len(r[1]) for r in ok if len(r[1]) % parts == 0), default=0)
    ok = sorted((r for r in ok if len(r[1]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    cut = [[[math.floor(scale * float(np.float32(x))) for x in r[1][p * w : (p + 1) * w]] for p in range(parts)] for r in ok]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda k: (dist(v, books[p][k]), k))
    for _ in range(rounds):
        codes = [[near(c[p], p) for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, codes, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = [[near(c[p], p) for p in range(parts)] for c in cut]
    out = [(r[0], r[2], bytes(a).hex(), sum(dist(c[p], books[p][a[p]]) for p in range(parts))) for r, c, a in zip(ok, cut, codes, strict=True)]
    return out, books


def check(spark, rows, parts=4, entries=256, rounds=4, scale=1024):
    df = spark.createDataFrame([(i, v, x, "clash", 1) for i, v, x in rows], SCHEMA).repartition(3)
    got, book = V.compress(df, carry=["label"], parts=parts, entries=entries, rounds=rounds, scale=scale)
    want, books = brute(rows, parts, entries, rounds, scale)
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    assert sorted(((r.vec_id, r.label, r.code.hex(), r.error) for r in got.collect()), key=key) == sorted(want, key=key)
    assert book.books.tolist() == books
    return book


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 8))
    rows = [(int(i), [float(x) for x in (centres[i % 9] + rng.normal(size=8) * 0.2).astype(np.float32)], int(i % 4) if i % 7 else None) for i in rng.permutation(400)]
    book = check(spark, rows, entries=12)
    # The bounds spare most of the comparisons after the first round.
    assert book.scans[0] == 4 * 400 and book.scans[-1] < 800, book.scans


def test_ties_repeats_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    few = [[float(x) / 1024 for x in rng.integers(-3, 4, 8)] for _ in range(6)]
    rows = [(i // 2, few[i % 6], i % 3) for i in range(60)]
    rows += [(-1, None, 0), (-2, [1.0, None] * 4, 0), (-3, [float("nan")] * 8, 0), (-4, [float("inf")] * 8, None), (-5, [-float("inf")] * 8, 1), (None, few[0], None), (-6, [], 1), (-7, [1.0] * 4, 1)]
    check(spark, rows, entries=16)


def test_fewer_rows_than_entries_and_large_components(spark):
    check(spark, [(1, [1e4, -1e4, 0.5, -0.0], 1), (2, [1e4, -1.00001e4, 0.5, 1e-9], 1)])
    with pytest.raises(Exception, match="too large"):
        check(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1)])


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    got, _ = V.compress(df, carry=["label"])
    assert got.collect() == []
    got, _ = V.compress(spark.createDataFrame([(1, [], 2, "", 0)], SCHEMA), carry=["label"])
    assert [(r.vec_id, r.code, r.error) for r in got.collect()] == [(1, bytes(4), 0)]


def test_label_sums_and_decoding(spark):
    rows = [(i, [i / 4, 0.0, 1.0, -i / 2], None if i < 3 else i % 2) for i in range(20)]
    df = spark.createDataFrame([(i, v, x, "", 1) for i, v, x in rows], SCHEMA)
    codes, book = V.compress(df, carry=["label"], entries=5, rounds=2)
    got = V.with_sums(codes, "label", "error", "label_error").collect()
    for r in got:
        assert r.label_error == sum(x.error for x in got if x.label == r.label)
    for r in V.decode(codes, book).collect():
        assert r.vector == [book.books[p][r.code[p]][0] / 1024 for p in range(4)]
    assert book.digest() == hashlib.sha256(",".join(str(x) for b in book.books for e in b for x in e).encode()).hexdigest()


def test_bounds_are_never_too_tight():
    """Whatever the entries' moves, assign() gives what scan() gives."""
    rng = np.random.default_rng(5)
    v = rng.integers(-40, 40, (300, 2, 3))
    books = rng.integers(-40, 40, (2, 10, 3))
    books[:, 7] = books[:, 2]  # equal entries: always tied
    code, upper, lower = np.zeros((300, 2), np.int64), np.zeros((300, 2), np.float32), np.zeros((300, 2), np.float32)
    for p in range(2):
        code[:, p], u, low = V.scan(v[:, p], books[p])
        upper[:, p], lower[:, p] = V._up(u), V._down(low)
    for step in range(30):
        new = books + rng.integers(-1, 2, books.shape) * (rng.random(books.shape) < 0.2)
        new[:, 7] = new[:, 2]
        book = V.Codebooks(new, np.sqrt(((new - books) ** 2).sum(2)) * (1 + 1e-12))
        V.assign(v, new, code, upper, lower, book.moved, book.half_gaps())
        for p in range(2):
            d = ((v[:, p][:, None] - new[p][None]) ** 2).sum(2)
            assert (code[:, p] == d.argmin(1)).all(), step
            d = np.sqrt(d)
            assert (upper[:, p] >= d[np.arange(300), code[:, p]]).all()
            d[np.arange(300), code[:, p]] = np.inf
            assert (lower[:, p] <= d.min(1)).all()
        books = new
