"""Literal cases of aggregates, relational operators, encodings, distributions, recurrences and pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import scalar as S
from panelloom.operators import aggregates as A
from panelloom.operators import distribution as D
from panelloom.operators import encode as E
from panelloom.operators import grid as G
from panelloom.operators import pairs as P
from panelloom.operators import relational as R
from panelloom.operators import scans as N
from panelloom.plans.catalog import ORACLE_SQL, QUERIES


def col(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_masked_mean(spark):
    df = spark.createDataFrame([(1.0, 10.0, 1), (3.0, 30.0, 1), (None, 50.0, 0)], "a double, b double, m int")
    r = df.agg(A.masked_mean(F.col("a"), F.lit(1)), A.masked_mean(F.col("b"), F.col("m"))).first()
    assert tuple(r) == (2.0, 20.0)


def test_quantization(spark):
    q = lambda v: A.quantization(col(spark, v).withColumn("e", F.lit(1)), ["e"], ["e"], ["i"], "x").first()
    r = q([72.0, 72.0, 73.0, 74.0])
    assert (r["n"], r["n_distinct"], r["frac_int"], r["min_increment"]) == (4, 3, 1.0, 1.0) and math.isclose(r["frac_unchanged"], 1 / 3)
    r = q([2.5, 2.7, 2.65])
    assert r["frac_int"] == 0 and math.isclose(r["min_increment"], 0.05)
    r = q([10.0, None, 11.0])
    assert (r["n"], r["n_distinct"], r["frac_unchanged"]) == (2, 2, None)


def test_log_and_mask(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 2), (None, 0)], "x double, m int")
    stats = spark.createDataFrame([("x", 5.0, 1.0)], "col string, mean double, std double")
    assert [r["x"] for r in A.normalize(df, stats, ["x"], {"x": "m"}, ("x",)).collect()] == [-5.0, 0.0, 0.0]
    assert col(spark, [3.0, 3.0]).agg(A.mean_std("x")[1]).first()[0] == 1.0


def test_most_complete(spark):
    rows = [(10, 1.0, 2.0, 0), (10, None, 2.0, 1), (20, 1.0, None, 2), (20, None, 3.0, 3), (30, None, None, 4)]
    df = spark.createDataFrame(rows, "id long, a double, b double, seq long")
    got = {r["id"]: (r["a"], r["b"]) for r in R.most_complete(df, ["id"], ["a", "b"], "seq").collect()}
    assert got == {10: (1.0, 2.0), 20: (1.0, None), 30: (None, None)}
    assert {r["id"]: r["differing"] for r in R.differing_columns(df, ["id"], ["a", "b"]).collect()} == {10: ["a"], 20: ["a", "b"]}


def test_keep_last_takes_the_first_of_equal_rows(spark, tmp_path):
    one_row = spark.createDataFrame([(1, 5, 0, "x"), (1, 5, 1, "y"), (1, 4, 2, "z"), (2, None, 1, "b"), (2, None, 0, "a"), (3, 1, 1, "d"), (3, None, 0, "c")], "id int, seq int, row int, v string").repartition(3)
    kept = lambda last: {r["id"]: r["v"] for r in R.keep_first(one_row, ["id"], ["seq"], last=last, ties=("row",)).collect()}
    assert kept(True) == {1: "x", 2: "a", 3: "d"} and kept(False) == {1: "z", 2: "a", 3: "c"}

    # files of several row groups, read in small splits; one thread of DuckDB reads them in order, several take any of equal rows
    con = duckdb.connect(config={"threads": 1})
    (tmp_path / "lineitem.parquet").mkdir()
    for k, n in enumerate((9000, 3000, 20000)):
        con.execute(f"""COPY (SELECT (hash(i, {k}) % 900)::BIGINT AS l_orderkey, (hash(i, {k}, 1) % 50)::DOUBLE AS l_quantity, CASE WHEN l_orderkey % 9 > 0 AND i % 7 > 0 THEN (hash(i, {k}, 2) % 4)::DOUBLE END AS l_extendedprice,
          0.05 AS l_discount, 0.01 AS l_tax, 'A' AS l_returnflag FROM range({n}) r(i)) TO '{tmp_path}/lineitem.parquet/part-{k}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)""")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["rel_dedup_keep_last"]).fetchall()
    split = "spark.sql.files.maxPartitionBytes"
    try:
        for size in ("16k", "128m"):
            spark.conf.set(split, size)
            got = [(r["id"], r["seq"], r["a_null"]) for r in QUERIES["rel_dedup_keep_last"](spark, str(tmp_path)).collect()]
            assert sorted(map(repr, got)) == sorted(map(repr, want))
    finally:
        spark.conf.unset(split)


def test_top_abs(spark):
    df = spark.createDataFrame([("a|b", 0.5), ("c|d", -0.9), ("e|f", 0.1)], "n string, x double")
    assert [r["n"] for r in R.top_abs(df, "x", "n", 2).collect()] == ["c|d", "a|b"]


def test_prefix_comparison(spark):
    t = [float(np.float32(v)) for v in (9499.5, 9500.0, 9500.5, 9501.0)]
    mk = lambda v: spark.createDataFrame(list(zip(t, v, strict=True)), "t double, x double")
    a, b = mk([2.0, 2.0, 1.888, 1.888]), mk([2.0, 2.0, 0.0, 0.0])
    assert R.compare_tables(a, b, ["t"], ["x"], F.col("t") < 9500.5).first()["n_differ"] == 0
    assert R.compare_tables(a, b, ["t"], ["x"]).first()["n_differ"] == 2


def test_nan_equals_nan_and_lone_rows_differ(spark):
    a = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "k int, x double")
    b = spark.createDataFrame([(1, float("nan")), (2, 0.0)], "k int, x double")
    r = R.compare_tables(a, b, ["k"], ["x"]).first()
    assert (r["n"], r["n_differ"], r["n_pattern"]) == (3, 2, 1)


def test_point_in_interval_buckets(spark):
    iv = spark.createDataFrame([(1, 0.0, 100.0, "a"), (1, 95.0, 96.0, "b"), (2, 0.0, 1.0, "c")], "e int, start double, end double, n string")
    pt = spark.createDataFrame([(1, 95.5), (1, 100.0), (1, 100.1), (2, 0.5)], "e int, t double")
    got = sorted((r["t"], r["n"]) for r in R.intervals_at(pt, iv, ["e"], 7.0).collect())
    assert got == [(0.5, "c"), (95.5, "a"), (95.5, "b"), (100.0, "a")]


def test_islands(spark):
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate([0.0, 1.0, 1.0, 0.0, None, 1.0])], "e int, t int, x double")
    got = sorted((r["start"], r["stop"], r["n"]) for r in R.islands(df, ["e"], ["t"], F.col("x") > 0.5).collect())
    assert got == [(1, 2, 2), (5, 5, 1)]


def test_normalize_item(spark):
    df = spark.createDataFrame([(" Ácido  Bé-ñ ",), ("12.0",), ("A//b c__n",), ("",)], "x string")
    assert [r[0] for r in df.select(S.normalize_item(F.col("x"))).collect()] == ["acido_be_n", "12", "a_b_c_n", ""]


def test_bucket_is_big_integer_modulo(spark):
    import hashlib

    for k in ("7", "abc", "cf:12"):
        assert one(spark, S.bucket(F.lit(k), 97)) == int(hashlib.sha256(k.encode()).hexdigest(), 16) % 97


def test_texts(spark):
    assert one(spark, S.time_in_text(F.lit("t=12.5s: stop"))) == 12.5 and one(spark, S.time_in_text(F.lit("stop"))) is None
    assert one(spark, S.number_in(F.lit("set to 250 mcg/min"))) == 0.25 and one(spark, S.number_in(F.lit("3 mg/min"))) == 3.0
    assert one(spark, S.to_number(F.lit("x"))) is None and one(spark, S.truthy(F.lit(" Yes "))) and one(spark, S.is_missing(F.lit(" NaN ")))


def test_distances_by_hand(spark):
    df = spark.createDataFrame([(x, True) for x in (0.0, 1.0, 3.0)] + [(x, False) for x in (5.0, 6.0, 8.0)], "x double, s boolean")
    r = D.distances(df, "x", F.col("s"), []).first()
    assert math.isclose(r["wasserstein"], 5.0) and r["ks"] == 1.0 and r["auc"] == 0.0
    same = df.select("x", F.explode(F.array(F.lit(True), F.lit(False))).alias("s"))
    r = D.distances(same, "x", F.col("s"), []).first()
    assert (r["wasserstein"], r["ks"], r["auc"]) == (0.0, 0.0, 0.5)


def test_information_orders(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=2000), rng.normal(size=2000)
    df = spark.createDataFrame([(float(a), float(a + 0.5 * b), float(b)) for a, b in zip(x, z, strict=True)], "x double, y double, z double")
    mi = lambda a, b: D.mutual_information(df, a, b).first()["mi"]
    assert mi("x", "x") > mi("x", "y") > mi("x", "z") >= 0
    assert D.mutual_information(df.limit(20), "x", "y").first()["mi"] == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vec = lambda c: [float(v) for v in rng.normal(c, 1, 4)]
    mk = lambda gap: spark.createDataFrame([(i, vec(gap * (i % 2)), i % 2) for i in range(120)], "id long, v array<float>, l int")
    near = lambda gap: np.mean([r["mean"] for r in D.neighbour_overlap(mk(gap), "v", "id", "l", 10).collect()])
    assert near(0) > 0.4 and near(20) < 0.05
    df = mk(0)
    whole = D.neighbour_overlap(df, "v", "id", "l", 10)
    rounded = lambda d: sorted((r["label"], r["n"], round(r["mean"], 9), round(r["median"], 9)) for r in d.collect())
    assert rounded(D.neighbour_overlap(df, "v", "id", "l", 10, pivots=3)) == rounded(whole)


def steps(spark, n, **cols):
    return spark.createDataFrame([(1, i, *[c(i) for c in cols.values()]) for i in range(n)], "e int, i int" + "".join(f", {k} double" for k in cols))


def test_decay(spark):
    for life in (300, 600):
        ke = math.log(2) / life
        df = steps(spark, 200, rate=lambda i: 0.0, bolus=lambda i: 100.0 if i == 0 else 0.0)
        got = [r["ce"] for r in N.effect_site(df, ["e"], ["i"], "rate", "bolus", ke, 5.0).orderBy("i").collect()]
        assert np.allclose(got, 100 * np.exp(-ke * 5 * np.arange(200)), rtol=1e-6)


def test_steady_state(spark):
    ke = math.log(2) / 300
    df = steps(spark, 2000, rate=lambda i: 50.0, bolus=lambda i: 0.0)
    got = np.array([r["ce"] for r in N.effect_site(df, ["e"], ["i"], "rate", "bolus", ke, 5.0).orderBy("i").collect()])
    assert abs(got[-1] / ((50 / 60) / ke) - 1) < 1e-5 and (np.diff(got) >= -1e-9).all()


def test_running_dose(spark):
    df = steps(spark, 100, rate=lambda i: 5.0, bolus=lambda i: {4: 20.0, 6: 10.0}.get(i, 0.0))
    last = N.running_dose(df, ["e"], ["i"], "bolus", "rate", 5.0).orderBy(F.desc("i")).first()["dose"]
    assert math.isclose(last, 30 + 5 * 99 * (5 / 60))


def test_recurrence_matches_loop(spark):
    x = np.random.default_rng(2).normal(size=333)
    df = steps(spark, 333, x=lambda i: float(x[i]))
    got = [r["y"] for r in N.linear_recurrence(df, ["e"], ["i"], 0.83, F.col("x"), y0=2.0, block=16).orderBy("i").collect()]
    y, want = 2.0, []
    for v in x:
        y = 0.83 * y + v
        want.append(y)
    assert np.allclose(got, want)


def test_linear_system_matches_fine_integration(spark):
    m = N.compartment_matrix(0.119, 0.112, 0.042, 0.055, 0.0033, 0.26)
    df = steps(spark, 240, rate=lambda i: 100.0 if i else 0.0)
    got = N.linear_system(df, ["e"], ["i"], "rate", m, 15.9, 5 / 60).orderBy(F.desc("i")).first()["ce"]
    y, h = np.zeros(4), 5 / 60 / 200
    for _ in range(239 * 200):
        y = y + h * (m @ y + np.array([100 / 15.9, 0, 0, 0]))
    assert abs(got / y[-1] - 1) < 1e-3


def test_encoding(spark):
    df = spark.createDataFrame([(1, 5.0, "yes", "A b"), (2, None, "0", None)], "id long, n double, f string, c string")
    stats = spark.createDataFrame([("n", 3.0, 2.0)], "col string, mean double, std double")
    got = sorted((r["id"], r["item"], r["value"]) for r in E.emit_tokens(df, "id", ["n"], ["f"], ["c"], stats).collect())
    assert got == [(1, "c:a_b", 1.0), (1, "f", 1.0), (1, "n", 1.0)]


def test_pairs(spark):
    a = spark.createDataFrame([(1, float(t), 1.0) for t in range(6)], "pair_id int, t double, x double")
    b = spark.createDataFrame([(1, float(t), 2.0 if t in (3, 4) else 1.0) for t in range(6)], "pair_id int, t double, x double")
    meta = spark.createDataFrame([(1, 2.0)], "pair_id int, split_t double")
    assert tuple(P.first_divergence(a, b, ["x"]).first()) == (1, 3.0, "x")
    assert P.prefix_identity(a, b, ["x"], meta).first()["same"] and P.effect_lag(a, b, ["x"], meta).first()["lag"] == 1
    assert tuple(P.reconvergence(a, b, ["x"]).first()) == (1, 4.0, 5.0)
    assert P.assemble(a, b, meta).first()["usable"] and not P.assemble(a, b.where("t > 0"), meta).first()["usable"]
    d = lambda v: F.lit(v).cast("double")
    assert one(spark, P.boundary(d(None), d(14.0), 5.0)) == 10.0 and one(spark, P.boundary(d(3.0), d(None), 5.0)) is None
    assert one(spark, P.null_cause(F.lit(False), d(9), d(5), d(0.1), d(0.5), F.lit(True))) == "below_resolution"


def test_infused_matches_linear_system(spark):
    m = N.compartment_matrix(0.119, 0.112, 0.042, 0.055, 0.0033, 0.26)
    grid = spark.createDataFrame([(1, 5.0 * i) for i in range(121)], "e int, t double")
    inf = spark.createDataFrame([(1, 0.0, 600.0, 100.0)], "e int, start double, end double, rate double")
    bol = spark.createDataFrame([(1, 302.4, 50.0), (2, 1.0, 9.0)], "e int, t double, dose double")
    got = {r["t"]: r["ce"] for r in N.infused(grid, inf, bol.limit(0), ["e"], m, 15.9).collect()}
    df = steps(spark, 121, rate=lambda i: 100.0)
    want = [r["ce"] for r in N.linear_system(df, ["e"], ["i"], "rate", m, 15.9, 5 / 60).orderBy("i").collect()]
    assert np.allclose([got[5.0 * i] for i in range(121)], want, rtol=2e-3, atol=1e-9)
    more = {r["t"]: r["ce"] for r in N.infused(grid, inf, bol, ["e"], m, 15.9).collect() if r["t"] is not None}
    assert more[300.0] == got[300.0] and more[310.0] > got[310.0]


def test_own_parameters(spark):
    from panelloom.functions import kinetics as K

    df = steps(spark, 50, rate=lambda i: 10.0).withColumn("p", K.marsh(F.lit(70.0)))
    got = [r["ce"] for r in N.compartments(df, ["e"], ["i"], "rate", "p", 5 / 60).orderBy("i").collect()]
    m = N.compartment_matrix(0.119, 0.112, 0.0419, 0.055, 0.0033, 0.26)
    want = [r["ce"] for r in N.linear_system(df, ["e"], ["i"], "rate", m, 0.228 * 70, 5 / 60).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_guards(spark):
    with pytest.raises(ValueError, match="secret"):
        R.check_columns(spark.createDataFrame([(1, 2)], "a int, secret int"), {"a"})
    df = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "x"), (1, 3, "x")], "e int, i int, x string")
    assert [r[0] for r in df.select(R.changed("x", ["e"], ["i"])).collect()] == [False, False, True, False]


@pytest.mark.parametrize("a", [0.0, 1e-300, 1e-12, 1e-6, 1e-4, 0.5, 1 - 1e-12])
def test_recurrence_over_all_coefficients(spark, a):
    b = [float(x) for x in np.random.default_rng(2).normal(0, 1, 150)]
    want, y = [], 3.0
    for x in b:
        y = a * y + x
        want.append(y)
    df = spark.createDataFrame([("e", i, x) for i, x in enumerate(b)], "e string, i int, x double")
    got = [r["y"] for r in N.linear_recurrence(df, ["e"], ["i"], a, F.col("x"), y0=3.0).orderBy("i").collect()]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_events_and_samples_that_are_no_numbers_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    events = spark.createDataFrame([("e", 1.0, nan), ("e", 2.0, 5.0), ("e", 3.0, inf), ("e", 4.0, -1.0), ("e", 4.0, None)], "e string, t double, value double")
    bounds = spark.createDataFrame([("e", 0.0, 10.0)], "e string, a0 double, a1 double")
    assert [tuple(r) for r in G.bin_events(events, bounds, ["e"], 5.0).collect()] == [("e", 1, 5.0)]
    grid = spark.createDataFrame([("e", 0, 3.5)], "e string, k int, t double")
    assert G.ffill_asof(events, grid, ["e"]).first()["value"] == 5.0


def test_comparison_by_type(spark):
    a = spark.createDataFrame([(1, "x", 2**60, 1.0), (2, None, 5, float("nan")), (3, "z", 7, None)], "k int, s string, n long, d double")
    b = spark.createDataFrame([(1, "y", 2**60 + 1, 1.5), (2, None, 5, float("nan")), (3, "z", None, 2.0), (4, "w", 1, 1.0)], "k int, s string, n long, d double")
    got = {r["col"]: tuple(r)[1:] for r in R.compare_tables(a, b, ["k"], ["s", "n", "d"], pattern_inf=True).collect()}
    assert got["s"] == (4, 2, 0, None) and got["n"] == (4, 3, 1, float("inf")) and got["d"][:3] == (4, 3, 1)


def test_quantiles_and_row_numbers_match_numpy(spark):
    from panelloom.operators import ordered as O

    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 700), (None, 55)) for v in rng.integers(0, 90, n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = [0.0, 0.01, 0.33, 0.5, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in O.quantiles(df, "x", ps, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        assert np.allclose(got[g], np.quantile([x for k, x in rows if k == g and x is not None], ps))
    assert np.allclose(O.quantiles(df, "x", ps, []).first()["q"], np.quantile([x for _, x in rows if x is not None], ps))
    ranks = sorted((r["g"] or "", r["rank"], r["n"]) for r in O.row_numbers(df, "x", ["g"], count="n").collect())
    assert ranks == sorted((g or "", i + 1, sum(k == g for k, _ in rows)) for g in {k for k, _ in rows} for i in range(sum(k == g for k, _ in rows)))


def test_case_bounds_by_hand(spark):
    obs = spark.createDataFrame([(1, 5.0), (1, 90.0), (2, 5.0), (2, 90.0), (3, 5.0)], "c int, t double")
    marks = spark.createDataFrame([(1, 0.0, 80.0, 10.0, None), (2, 20.0, 0.0, 10.0, 70.0)], "c int, case_start double, case_end double, ane_start double, ane_end double")
    assert sorted(map(tuple, G.case_bounds(obs, marks, ["c"]).collect())) == [(1, 10.0, 80.0), (2, 20.0, 70.0), (3, 5.0, 5.0)]
    assert G.make_grid(G.case_bounds(obs, marks, ["c"]), 5.0).where("c = 3").count() == 0


def test_shared_out_totals(spark):
    n = spark.createDataFrame([("a", 50), ("b", 30), ("c", 21), ("d", 1)], "g string, n long")
    take = lambda t: [r["take"] for r in E.largest_remainder(n, ["g"], "n", t).orderBy("g").collect()]
    assert take(10) == [5, 3, 2, 0] and take(0) == [0, 0, 0, 0] and take(500) == [50, 30, 21, 1] and sum(take(37)) == 37


def test_ks_p_value(spark):
    row = spark.range(1).select(D.ks_p_value(F.lit(0.2), F.lit(100.0), F.lit(120.0)).alias("p"), D.ks_p_value(F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("one")).first()
    lam2 = 0.04 * 100 * 120 / 220
    assert abs(row["p"] - 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam2) for k in range(1, 60))) < 1e-12 and row["one"] == 1.0
