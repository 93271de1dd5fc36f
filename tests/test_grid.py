"""Literal cases of grids, masks and windows."""

import pytest
from pyspark.sql import functions as F

from panelloom.operators import grid as G
from panelloom.operators import windows as W


def obs(spark, pairs, entity=1):
    return spark.createDataFrame([(entity, float(t), v, i) for i, (t, v) in enumerate(pairs)], "entity long, t double, value double, seq long")


def grid(spark, times, entity=1):
    return spark.createDataFrame([(entity, k, float(t)) for k, t in enumerate(times)], "entity long, k int, t double")


def values(df, col="value"):
    return [r[col] for r in df.orderBy("entity", "t").collect()]


def test_hold(spark):
    s = obs(spark, [(10 + i, float(v)) for i, v in enumerate([30, 30, 40, 40, 40, 50, 50, 50, 50, 50, 60])])
    assert values(G.ffill_asof(s, grid(spark, [10, 15, 20]), ["entity"])) == [30, 50, 60]
    s = obs(spark, [(10 + i, float(v)) for i, v in enumerate([30, 30, 30, 40, 40, 40, 40])])
    assert values(G.ffill_asof(s, grid(spark, [10, 15, 20]), ["entity"])) == [30, 40, 40]
    assert values(G.ffill_asof(s, grid(spark, [5]), ["entity"])) == [None]


@pytest.mark.parametrize("bucket", [None, 40.0, 7.0])
def test_bounded_age(spark, bucket):
    times = [5.0 * i for i in range(100)]
    s = obs(spark, [(t, None if 50 <= t < 170 else 10.0) for t in times])
    out = G.ffill_asof(s, grid(spark, times), ["entity"], 30.0, bucket=bucket).orderBy("t").collect()
    assert [r["present"] for r in out] == [int(t < 80 or t >= 170) for t in times]
    assert all((r["value"] == 10.0) == bool(r["present"]) for r in out)


def test_missing_values_do_not_count(spark):
    s = obs(spark, [(0, 1.0), (1, float("nan")), (2, float("inf")), (3, None)]).withColumn("value", G.finite("value"))
    assert values(G.ffill_asof(s, grid(spark, [4]), ["entity"])) == [1.0]
    e = spark.createDataFrame([], "entity long, t double, value double, seq long")
    assert values(G.ffill_asof(e, grid(spark, [4]), ["entity"])) == [None]
    assert G.ffill_asof(s, grid(spark, [1]).limit(0), ["entity"]).count() == 0


def test_ties_take_the_last_in_order(spark):
    s = obs(spark, [(1, 5.0), (1, 7.0)])
    assert values(G.ffill_asof(s, grid(spark, [1]), ["entity"], seq="seq")) == [7.0]


def test_make_grid(spark):
    b = spark.createDataFrame([(1, 0.0, 12.0), (2, 5.0, 5.0), (3, 0.0, 10.0)], "entity long, a0 double, a1 double")
    got = sorted((r["entity"], r["t"]) for r in G.make_grid(b, 5).collect())
    assert got == [(1, 0.0), (1, 5.0), (1, 10.0), (3, 0.0), (3, 5.0)]


def test_bin_events(spark):
    b = spark.createDataFrame([(1, 100.0, 120.0)], "entity long, a0 double, a1 double")
    e = obs(spark, [(90, 1.0), (100, 2.0), (101, 4.0), (105, 8.0), (115, 16.0), (116, 32.0), (110, -5.0), (107, None)])
    got = {r["k"]: r["total"] for r in G.bin_events(e, b, ["entity"], 5).collect()}
    assert got == {0: 3.0, 1: 12.0, 3: 16.0}


def test_nearest_and_quantize(spark):
    r = spark.range(1).select(
        G.nearest_cell(F.lit(2.5), F.lit(0.0), 5).alias("tie"), G.nearest_cell(F.lit(2.6), F.lit(0.0), 5).alias("up"),
        G.quantize(F.lit(2.5), 1.0).alias("even"), G.quantize(F.lit(3.5), 1.0).alias("odd"), G.floor_to(F.lit(14.9), 5).alias("floor"),
    ).first()
    assert tuple(r) == (0, 1, 2.0, 4.0, 10.0)


def test_three_state(spark):
    x = [1.0, 1.0, None, 1.0, None, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    state = lambda a, b: [r[0] for r in df.orderBy("i").select(G.three_state(F.col("x"), F.lit(a), F.lit(b))).collect()]
    assert state(False, True) == [1] * 6 and state(True, False) == [2] * 6 and state(True, True) == [0, 0, 2, 0, 2, 0]


def test_trim_keeps_inner_gaps(spark):
    g = grid(spark, range(6)).withColumn("m", F.when(F.col("k").isin(1, 4), 1).otherwise(0))
    got = G.trim_edges(g, ["entity"], ["m"]).orderBy("k").collect()
    assert [r["k"] for r in got] == [1, 2, 3, 4] and (got[0]["n_head"], got[0]["n_tail"]) == (1, 1)


def cells(spark, times, **cols):
    n = len(times)
    rows = [(1, int(t), *[c[i] for c in cols.values()]) for i, t in enumerate(times)]
    kinds = {"phase": "string"}
    return spark.createDataFrame(rows, "entity long, t long" + "".join(f", {k} {kinds.get(k, 'double')}" for k in cols)), n


def test_transition_window(spark):
    df, n = cells(spark, range(100, 161, 5), ce=[float(i) for i in range(13)], bolus=[1.0] * 13, dose=[10.0 * i for i in range(13)])
    got = W.transition_windows(df, ["entity"], 5, 12, ["ce", "dose"], ["ce"], ["bolus"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["t0"], r["t1"], r["ce_t0"], r["ce_t1"], r["ce_max"], r["bolus_sum"], r["dose_t1"]) == (100, 160, 0, 12, 12, 12, 120)


def test_hole_and_phase(spark):
    df, _ = cells(spark, [*range(100, 156, 5), 170], ce=[1.0] * 13)
    assert W.transition_windows(df, ["entity"], 5, 12, ["ce"]).count() == 0
    df, n = cells(spark, range(100, 221, 5), ce=[1.0] * 25, phase=["maintenance" if t < 165 else "emergence" for t in range(100, 221, 5)])
    assert [r["t0"] for r in W.transition_windows(df, ["entity"], 5, 12, ["ce"], phase="phase").collect()] == [100]
    d = W.discard_counts(df, ["entity"], 5, 12, "phase").first()
    assert (d["n_hole"], d["n_start"], d["n_end"], d["n_valid"]) == (12, 0, 12, 1)


def test_worst_state_priority(spark):
    for mask, want in (([0.0, 2.0, 0.0], 2), ([0.0, 2.0, 1.0], 1), ([0.0, 0.0, 0.0], 0)):
        df, _ = cells(spark, [0, 5, 10], m=mask)
        assert W.transition_windows(df, ["entity"], 5, 2, masks=["m"]).first()["m_worst"] == want


def test_anchor_stride(spark):
    df = spark.createDataFrame([(1, t) for t in (5, 10, 65, 70, 125)], "entity long, t0 long")
    assert sorted(r["t0"] for r in W.anchor_stride(df, ["entity"], 60).collect()) == [5, 65, 125]


def test_endpoint_cascade(spark):
    c = lambda v: F.lit(v).cast("double")
    row = lambda *v: tuple(spark.range(1).select(*G.endpoint_cascade(*map(c, v))).first())
    assert row(None, None, 0.0, 12.0) == (0.0, 12.0, 1) and row(50.0, 50.0, 0.0, 12.0) == (50.0, 50.0, 0) and row(50.0, None, None, 1.0) == (None, None, 2)


def test_phase_labels(spark):
    c = lambda v: F.lit(v).cast("double")
    row = lambda *v: spark.range(1).select(G.phase_label(*map(c, v))).first()[0]
    assert [row(5, None, 9), row(5, 6, 9), row(6, 6, 9), row(9, 6, 9), row(99, 6, None)] == ["unknown", "induction", "maintenance", "emergence", "maintenance"]
