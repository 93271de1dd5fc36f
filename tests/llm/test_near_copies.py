import numpy as np

import corpus_pipeline as C
from panelloom.llm import near_copies as N


def brute(texts, size=5, least=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and len(a & b) >= least * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def planted():
    """Families of near copies from 1 to 30 changed words, chains, one passage in many texts, and short texts."""
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    out, passage = ["", None, "one two", "One  two", "one two three", "a b c d e", "a b c d e f"], text(12)
    for f in range(12):
        base = text(int(rng.integers(20, 300)))
        out.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for at in rng.integers(0, len(copy), max(1, len(copy) * (f + 1) // 400)):
                copy[at] = f"c{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
            if f % 3 == 0:
                base = copy
    out += [" ".join(passage + text(30)) for _ in range(40)]
    return [out[i] for i in rng.permutation(len(out))]


def test_components_match_brute_force(spark):
    texts = planted()
    want = brute(texts)
    assert 20 < len(set(want)) < len(want) - 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for rounds, few, radius, wide in ((2, 16, 2, 256), (0, 3, 5, 4)):
        got = {r["doc_id"]: r["component_id"] for r in N.linked(docs, rounds=rounds, few=few, radius=radius, wide=wide).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_stage_drops_near_copies(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, tok int")
    kept = C.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(brute(texts)) | {None}
    assert C.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_hot_shingles_come_last_and_lose_nothing(spark):
    """One passage in 300 texts whose other words are few: its buckets are large, and the order is taken again."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(90)]
    texts = [" ".join([f"w{x}" for x in rng.integers(0, 50, 4)] + passage + [f"w{x}" for x in rng.integers(0, 30, 3 + k % 60)]) for k in range(300)]
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.linked(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want)) < 300


def test_order_puts_common_shingles_last():
    order = N.Order({5: 10, -7: 300, 9: 20})
    assert order.places(np.array([9, 5, 1, -7], np.int64).view(np.uint64)).tolist() == [2, 1, 0, 3]
    assert N.Order({}).places(np.array([1], np.uint64)).tolist() == [0]


def bucket_rows(texts, first=None):
    """Rows of `unsettled` by hand: each text a component of its own, places in the order of bucket size and value, late last."""
    words = [t.split() for t in texts]
    sets = [sorted({hash(" ".join(w[i : i + 5])) for i in range(len(w) - 4)}) for w in words]
    size = {}
    for x in sets:
        for t in x:
            size[t] = size.get(t, 0) + 1
    firsts = [sorted(x, key=lambda t: (size[t], t))[: len(x) - -(-4 * len(x) // 5) + 1] for x in sets]
    m = {}
    for x in firsts:
        for t in x:
            m[t] = m.get(t, 0) + 1
    return [(t, k, len(sets[k]), i, m[t], k) for k, x in enumerate(firsts) for i, t in enumerate(x) if m[t] > 1], [set(x) for x in sets]


def test_pairs_left_hold_every_link_and_templates_make_none(spark):
    schema, share = "tok long, node long, n int, i int, m long, c long", N.Fraction(4, 5)
    rows, sets = bucket_rows([t for t in planted() if t and len(t.split()) > 5])
    links = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    assert len(links) > 200
    for wide in (2, 10, 1000):
        got = {(max(r), min(r)) for r in N.unsettled(spark.createDataFrame(rows, schema), share, wide).collect()}
        assert links <= got and len(got) < len(sets) ** 2 / 8
    rng, page = np.random.default_rng(8), [f"t{i}" for i in range(160)]
    rows, sets = bucket_rows([" ".join([f"w{x}" for x in rng.integers(0, 10**9, 30 + k % 20)] + page) for k in range(1500)])
    assert max(r[4] for r in rows) > 400  # the template is among the first of many
    assert N.unsettled(spark.createDataFrame(rows, schema), share, 256).isEmpty()


def test_columns_with_names_of_the_stage(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x", 2), (1, "a b c", 5, "w", 2), (2, "A b c", 6, "y", 3)], "doc_id long, text string, __id0 int, __digest0 string, __row int")
    assert [tuple(r) for r in N.one_of_each(docs).collect()] == [(1, "a b c", 5, "w", 2)]


def test_common_phrases_make_no_large_buckets(spark, monkeypatch):
    """Texts with phrases that some dozens of others have, too: the buckets that are left follow the texts, not their square."""
    seen, rng = {}, np.random.default_rng(9)
    phrases = [" ".join(f"p{x}" for x in rng.integers(0, 10**6, 9)) for _ in range(60)]
    old = N.possible

    def counted(pairs, parts, share):
        seen.setdefault(len(texts), pairs.count())
        return old(pairs, parts, share)

    monkeypatch.setattr(N, "possible", counted)
    monkeypatch.setattr(N, "linked_codes", lambda codes, *_: codes.sparkSession.createDataFrame([], "u long, v long"))
    monkeypatch.setattr(N, "common_shingles", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    for n in (300, 900):
        texts = [" ".join([phrases[i] for i in rng.integers(0, 60, 4)] + [f"w{x}" for x in rng.integers(0, 10**6, 60)]) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = N.linked(docs, few=10**6)
        assert found.select("component_id").distinct().count() == n
    assert seen[900] < 4 * max(seen[300], 100), seen


def test_parities_leave_out_pairs_that_differ_too_much(spark):
    """A group of near copies of one text, each with some words of its own: all meet, and few are links."""
    rng, share = np.random.default_rng(4), N.Fraction(4, 5)
    base, texts = [f"b{i}" for i in range(90)], []
    for k in range(400):
        words = list(base)
        for at in rng.choice(90, 3 if k % 2 else 1, replace=False):
            words[at] = f"c{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    outlined = N.outlines(N._source(docs, "doc_id", "text"), N.Order({}), 5, share).collect()
    odd = spark.createDataFrame([(r["doc_id"], *(r[x] for x in N.ODD)) for r in outlined], "node long, " + ", ".join(f"{x} long" for x in N.ODD))
    words = [t.split() for t in texts]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    links = {(a, b) for a in range(400) for b in range(a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])}
    now = spark.createDataFrame([(1, k, len(sets[k]), 0, 400, k) for k in range(400)], "tok long, node long, n int, i int, m long, c long")
    found = {(max(r), min(r)) for r in N.unsettled(now, share, 256, odd).collect()}
    assert links <= found and len(found) < len(links) + 400 * 399 / 20


def test_apart_keeps_every_row_once(spark):
    rows = spark.range(3000).selectExpr("if(id % 7 = 0, null, id) AS `a.b`", "id")
    for keys in ([], [5], list(range(0, 3000, 3))):
        held = spark.createDataFrame([(k,) for k in keys], "k long")
        stays, rest = N.apart(rows, N.F.col("`a.b`"), held)
        stays, rest = stays.collect(), rest.collect()
        assert sorted(r["id"] for r in stays + rest) == list(range(3000))
        assert not {r["a.b"] for r in stays} & set(keys)
        assert len(rest) <= len(keys) + 3000 // 5


def test_texts_that_stay_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"a b c d e w{i // 2}") for i in range(40)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = N.one_of_each(docs)
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert plan.startswith("Union") and "getbit" in plan.lower()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
