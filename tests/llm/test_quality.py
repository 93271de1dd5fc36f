import numpy as np
import pyarrow as pa

from panelloom.llm import _text as T
from panelloom.llm import quality as Q

GOOD = "The quiet river runs past an old mill, and nobody has counted its {} stones. Rain came late."
BAD = "BUY!! NOW!! {} $$$ ### BUY!! NOW!! BUY!! NOW!! ||| "


def rows(n=60):
    return [(i, (GOOD if i % 2 else BAD).format(i) * (1 + i % 3), 1) for i in range(n)]


def test_statistics_by_hand():
    x = dict(zip(Q.STATS, Q.stats(*T.buffers(pa.array(["Ab cd cd\ncd 1!|"])))[0], strict=True))
    assert round(float(np.expm1(x["log_words"])), 6) == 5 and x["distinct_words"] == 3 / 5
    assert x["upper"] == 1 / 8 and x["exclaim"] == 1 / 15 and x["bar"] == 1 / 15 and x["digit"] == 1 / 15
    assert (Q.stats(*T.buffers(pa.array([None, ""], pa.string()))) == 0).all()


def test_rules_learn_and_compile(spark):
    docs = spark.createDataFrame(rows() + [(900, None, 1), (901, "", 1), (902, GOOD.format("many") * 3000, 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (5000, 1), (None, 1), (3, 7)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    assert 0 < len(model.rules) < 40
    out = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    assert len(out) == 63 and all(0 <= s <= 1 for s in out.values())
    assert all((out[i] >= 0.5) == bool(i % 2) for i in range(60))
    x = np.concatenate([Q.stats(d, o) for _, _, d, o in T.slices(pa.array([t for _, t, _ in rows()]))])
    r = Q._rule_matrix(x, [c for _, c in model.rules])
    want = 1 / (1 + np.exp(-(model.bias + r @ np.array([w for w, _ in model.rules]))))
    assert np.allclose([out[i] for i in range(60)], want)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.score(docs, model).first()["score"] == 0.5
    assert Q.score(docs.limit(0), model).count() == 0


def test_lasso_weights_meet_the_conditions_of_the_minimum():
    rng = np.random.default_rng(0)
    r = rng.integers(0, 2, (400, 12)).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 3])))).astype(float)
    for lam in (0.03, 0.003):
        w = Q._lasso(r, y, lam, np.zeros(13), rounds=5000)
        slope = np.hstack((np.ones((400, 1)), r)).T @ (1 / (1 + np.exp(-(w[0] + r @ w[1:]))) - y) / 400
        assert abs(slope[0]) < 1e-4 and (np.abs(slope[1:]) <= lam + 1e-4).all()
        on = np.abs(w[1:]) > 1e-4
        assert on.any() and np.allclose(slope[1:][on], -lam * np.sign(w[1:][on]), atol=1e-4)


def test_boosting_against_plain_stumps():
    """Depth 1 on one statistic: the first tree's split has the best gain of all splits."""
    from panelloom.llm import trees as G

    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (120, 1)).astype(float)
    y = (x[:, 0] + rng.normal(0, 2, 120) > 4).astype(float)
    bias, trees = G.boost(x, y, rounds=1, depth=1, rate=1.0, least=1, l2=1.0)
    p = y.mean()
    gain = {}
    for t in np.unique(x)[:-1] + 0.5:
        left = x[:, 0] < t
        gain[t] = sum((y - p)[s].sum() ** 2 / (s.sum() * p * (1 - p) + 1) for s in (left, ~left))
    f, t, a, b = trees[0].nodes[0]
    assert t == max(gain, key=gain.get) and abs(bias - np.log(p / (1 - p))) < 1e-12
    left = x[:, 0] < t
    assert np.isclose(trees[0].nodes[a], (y - p)[left].sum() / (left.sum() * p * (1 - p) + 1))


def test_order_and_repeats_do_not_matter(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a, b = Q.fit(docs, labels), Q.fit(docs.orderBy(Q.F.desc("doc_id")).repartition(7), labels.repartition(5))
    assert a == b
    twice = Q.score(docs.unionAll(docs), a).collect()
    assert len(twice) == 120 and len({(r["doc_id"], r["score"]) for r in twice}) == 60


def test_no_cap_on_rules():
    rng = np.random.default_rng(3)
    x = rng.random((3000, len(Q.STATS)))
    y = (np.sin(40 * x[:, 0]) + np.cos(50 * x[:, 5]) + x[:, 16] > 0.5).astype(float)
    model = Q.fit_rules(x, y, rounds=60, depth=4)
    assert len(model.rules) > 160
