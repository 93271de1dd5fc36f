import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import kinetics as K
from panelloom.operators import scans as S
from panelloom.operators.carried import Affine, Finite, scan

SIZES = {0: 1, 1: 700, 2: 3, 3: 0, 4: 1, 5: 60, None: 20}  # one entity has most of the rows


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(e, i, float(rng.integers(-4, 5)), float(rng.random())) for e, n in SIZES.items() for i in range(n)]
    rng.shuffle(data)
    data = [(None if e is None or e != e else int(e), int(i), float(x), float(a)) for e, i, x, a in data]
    return data, spark.createDataFrame(data, "e int, i int, x double, a double").repartition(5)


def entities(data):
    for e in {r[0] for r in data}:
        yield e, sorted((r for r in data if r[0] == e), key=lambda r: r[1])


@pytest.mark.parametrize("per_task", [50, 333, 10_000])
def test_affine_equals_a_loop(rows, per_task, monkeypatch):
    data, df = rows
    monkeypatch.setattr("panelloom.operators.carried._BATCH", 37)
    turn = np.array([[0.6, -0.5], [0.5, 0.6]])
    kind = Affine(
        2, lambda before, here: (here["a"][:, None, None] * turn, np.stack([here["x"], here["x"] - before["x"]], 1)), lambda here: np.stack([here["x"], np.ones(len(here["x"]))], 1), ((1.0, 0.0), (2.0, 1.0))
    )
    got = {(r.e, r.i): (r.u, r.v) for r in scan(df, ["e"], ["i"], kind, ["x", "a"], ["u", "v"], rows_per_task=per_task).collect()}
    assert len(got) == len(data)
    for e, own in entities(data):
        y = None
        for k, (_, i, x, a) in enumerate(own):
            y = np.array([x, 1.0]) if k == 0 else a * turn @ y + np.array([x, x - own[k - 1][2]])
            assert np.allclose(got[e, i], (y[0], 2 * y[0] + y[1])), (e, i)


@pytest.mark.parametrize("per_task", [60, 10_000])
def test_descending_gives_the_next_value(rows, per_task):
    data, df = rows
    got = {(r["e"], r["i"]): r["n"] for r in S._with_next(df.select("e", "i", "x"), ["e"], ["i"], "x", "n").collect()}
    for e, own in entities(data):
        for k, r in enumerate(own):
            assert got[e, r[1]] == (own[k + 1][2] if k + 1 < len(own) else 0.0)


@pytest.mark.parametrize("per_task", [45, 10_000])
def test_finite_equals_a_loop(rows, per_task):
    data, df = rows
    rng = np.random.default_rng(2)
    tables = rng.integers(0, 6, (9, 6))
    kind = Finite(6, lambda before, here: tables[here["x"].astype(int) + 4], lambda here: (here["x"].astype(int) + 4) % 6, tuple(float(10 * s) for s in range(6)))
    got = {(r.e, r.i): r.s for r in scan(df, ["e"], ["i"], kind, ["x"], ["s"], rows_per_task=per_task).collect()}
    for e, own in entities(data):
        for k, (_, i, x, _) in enumerate(own):
            s = (int(x) + 4) % 6 if k == 0 else tables[int(x) + 4][s]
            assert got[e, i] == 10 * s


def test_no_rows(spark):
    df = spark.createDataFrame([], "e int, i int, x double")
    assert S.controller(df, ["e"], ["i"], "x", 1.0, 2.0, 0.5, 1.0, 1).collect() == []


def test_controller_equals_a_loop(rows, spark, monkeypatch):
    data, df = rows
    df = df.withColumn("x", F.when(F.col("x") != 4, F.col("x")))
    low, high, step, top, hold = -1.0, 2.0, 0.4, 1.0, 3
    monkeypatch.setattr("panelloom.operators.carried.ROWS", 50)
    got = {(r.e, r.i): r.level for r in S.controller(df, ["e"], ["i"], "x", low, high, step, top, hold).collect()}
    for e, own in entities(data):
        level, since = 0.0, hold
        for _, i, x, _ in own:
            since += 1
            if since > hold and x != 4:
                new = min(top, level + step) if x < low else 0.0 if x > high else level
                if new != level:
                    level, since = new, 0
            assert got[e, i] == pytest.approx(level)


def test_boluses_and_drugs_equal_loops(rows):
    """Seven drugs over one hot and some small entities, by steps of each drug."""
    data, df = rows
    df = df.withColumns({"rate": F.when(F.col("x") > 0, F.col("x")), "bolus": F.when(F.col("a") > 0.7, F.col("a") * 10)})
    p = K.marsh(F.lit(70.0))
    r, b = F.col("rate"), F.col("bolus")
    drugs = {"lin": S.Drug("linear", r, b, p), "exp": S.Drug("exponential", r, b, ke=0.01), "raw": S.Drug("rate", r, b)}
    got = {(x.e, x.i, x.drug): x.ce for x in S.drug_effects(df, ["e"], ["i"], drugs, 5.0).collect()}
    m = S.compartment_matrix(0.119, 0.112, 0.0419, 0.055, 0.0033, 0.26)
    phi, psi = S.taylor(m * 5 / 60)
    for e, own in entities(data):
        rate = [max(x, 0.0) for _, _, x, _ in own]
        bolus = [a * 10 if a > 0.7 else 0.0 for *_, a in own]
        at = [bolus[k + 1] if k + 1 < len(own) else 0.0 for k in range(len(own))]  # a bolus acts a cell early
        at[0] += bolus[0]
        y, z = np.zeros(4), 0.0
        for k, (_, i, _, _) in enumerate(own):
            y, z = y + np.array([at[k] / (0.228 * 70), 0, 0, 0]), z + at[k]
            assert got[e, i, "lin"] == pytest.approx(y[3], abs=1e-9) and got[e, i, "exp"] == pytest.approx(z, abs=1e-7) and got[e, i, "raw"] == rate[k]
            if k + 1 < len(own):
                y = phi @ y + psi[:, 0] * (5 / 60) * rate[k + 1] / (0.228 * 70)
                z = z * np.exp(-0.05) + rate[k + 1] / 60 / 0.01 * (1 - np.exp(-0.05))
