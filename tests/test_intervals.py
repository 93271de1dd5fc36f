import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import intervals as I
from panelloom.operators import relational as R
from panelloom.operators import scans as S
from panelloom.operators.asof import asof_join
from panelloom.operators.ordered import quantiles

IV = "e int, start double, end double, v double, seq int"


def intervals(rng, n):
    out = []
    for k in range(n):
        a = float(rng.integers(-500, 500)) / 2
        b = a + float(rng.choice([0, 0.5, 1, 3, 17, 200, 90_000, 3e12]))
        b = [None, math.nan, math.inf][k % 3] if k % 7 == 0 else b
        a = None if k % 31 == 0 else a
        out.append((int(rng.integers(0, 3)), a, b, float(k), k))
    return out + [(1, 5.0, 4.0, -1.0, n)]  # ends before it starts


def holds(t, a, b, closed=True):
    ok = a is None or t >= a
    return ok and (b is None or b != b or b == math.inf or (t <= b if closed else t < b)) and not (a is not None and b is not None and b == b and b < a)


@pytest.mark.parametrize("closed", [True, False])
def test_points_in_intervals_of_any_length(spark, closed):
    rng = np.random.default_rng(1)
    iv = intervals(rng, 200)
    pt = [(int(rng.integers(0, 4)), float(t) / 4, k) for k, t in enumerate(rng.integers(-1200, 1200, 150))] + [(1, None, 998), (1, math.nan, 999)]
    a, p = spark.createDataFrame(iv, IV), spark.createDataFrame(pt, "e int, t double, row int")
    got = sorted((r.row, r.seq) for r in I.intervals_at(p, a, ["e"], 2.0, closed=closed).collect())
    want = sorted((row, s) for e, t, row in pt for f, x, y, _, s in iv if e == f and t is not None and t == t and holds(t, x, y, closed))
    assert got == want
    # Two rows an interval at most, whatever its length.
    assert I.binned(a, 2.0).groupBy("seq").count().where("count > 2").count() == 0
    last = {r.row: r.v for r in I.last_writer(p, a, ["e"], "row", "v", "seq", F.lit(-5.0), 2.0, closed=closed).collect()}
    first = {r.row: r.v for r in I.last_writer(p, a, ["e"], "row", "v", "seq", F.lit(-5.0), 2.0, last=False, closed=closed).collect()}
    for _, _, row in pt:
        own = [s for r, s in want if r == row]
        assert (last[row], first[row]) == ((float(max(own)), float(min(own))) if own else (-5.0, -5.0))
    assert {r.row for r in I.covered(p, a, ["e"], "row", 2.0, closed=closed).where("covered = 1").collect()} == {r for r, _ in want}


def test_actions_hold_until_the_next_and_the_last_for_ever(spark):
    acts = spark.createDataFrame([(1, 0.0, 2.0), (1, 10.0, 3.0), (2, 0.0, 2.0), (2, 10.0, 0.0)], "e int, t double, rate double")
    iv = R.actions_to_intervals(acts, ["e"], ["t"], "t", "rate")
    pt = spark.createDataFrame([(1, 15.0, 0), (1, 5.0, 1), (2, 15.0, 2), (1, 1e12, 3), (1, -1.0, 4)], "e int, t double, row int")
    got = {r.row: r.rate for r in R.last_writer(pt, iv, ["e"], "row", "rate", "start", F.lit(0.0), 5.0).collect()}
    assert got == {0: 3.0, 1: 2.0, 2: 0.0, 3: 3.0, 4: 0.0}
    cut = spark.createDataFrame([(1, 12.0), (1, 40.0), (1, 10.0)], "e int, cut double")
    got = sorted(R.split_intervals(iv.where("e = 1").withColumn("id", F.col("start").cast("int")), cut, ["e"]).select("start", "end").collect(), key=lambda r: r[0])
    assert [tuple(r) for r in got] == [(0.0, 10.0), (10.0, 12.0), (12.0, 40.0), (40.0, None)]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize(("exact", "later"), [(True, False), (False, True)])
def test_asof_of_irregular_series(spark, direction, exact, later):
    rng = np.random.default_rng(2)
    s = [(int(rng.integers(0, 3)) or None, float(t) / 2, k) for k, t in enumerate(rng.integers(0, 300, 80))] + [(1, None, 900)]
    p = [(int(rng.integers(0, 3)) or None, float(t) / 2, k) for k, t in enumerate(rng.integers(-20, 320, 120))] + [(1, None, 901)]
    sd, pd_ = spark.createDataFrame(s, "e int, t double, v int"), spark.createDataFrame(p, "e int, t double, row int")
    rows = asof_join(pd_, sd, ["e"], ["v"], direction, 6.0, bucket=10.0, exact=exact, later=later, seq="v").collect()
    assert len(rows) == len(p)
    for r in rows:
        own = {t: max(v for f, u, v in s if f == r.e and u == t) for e, t, _ in s if e == r.e and t is not None}
        if r.t is None:
            assert r.v is None
            continue
        back = max((t for t in own if t < r.t or exact and t == r.t), default=None)
        ahead = min((t for t in own if t > r.t or exact and t == r.t), default=None)
        if direction == "nearest":
            both = [t for t in (back, ahead) if t is not None]
            best = min(both, key=lambda t: (abs(t - r.t), -t if later else t), default=None)
        else:
            best = back if direction == "backward" else ahead
        best = best if best is not None and abs(best - r.t) <= 6 else None
        assert (r.v, r.sample_t) == ((own[best], best) if best is not None else (None, None)), (r, back, ahead)


def test_strict_sum_of_close_times(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0), (1, 10.5, 7.0), (1, 10.5, 1.0), (1, 12.0, 2.0), (2, 1.0, 3.0)], "e int, t double, x double")
    got = sorted((r.e, r.t, r.x, r.s) for r in df.withColumn("s", S.running_sum("x", ["e"], ["t"], strict=True)).collect())
    assert got == [(1, 10.0, 5.0, 0.0), (1, 10.5, 1.0, 5.0), (1, 10.5, 7.0, 5.0), (1, 12.0, 2.0, 13.0), (2, 1.0, 3.0, 0.0)]


def test_missing_values_take_no_part_in_quantiles(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (None,), (float("inf"),)], "x double")
    assert quantiles(df, "x", [0.0, 0.5, 1.0], []).first()["q"] == [1.0, 1.5, 2.0]
