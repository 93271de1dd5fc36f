import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import encode as E
from panelloom.operators import ordered as O
from panelloom.operators import positions as P
from panelloom.operators import probes
from panelloom.operators import sketches as K
from panelloom.operators import vector_index as V
from panelloom.sources import io
from panelloom.sources.ledger import Ledger


@pytest.mark.parametrize("per_task", [100, 10_000])
def test_positions_at_few_values_and_many_nulls(spark, per_task):
    rows = [(k, None if k % 3 else k % 2, k % 5) for k in range(1500)]
    df = spark.createDataFrame(rows, "id int, x int, y int").repartition(6)
    got = {r.id: r.position for r in P.positions(df, ["x", "id"], rows_per_task=per_task).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(want)}
    # Equal values are split: no task has over twice the mean.
    sizes = [r["n"] for r in P.sorted_runs(df, ["x"], 100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 12 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert P.positions(df.limit(0), ["x"]).count() == 0


def test_sorted_table_and_sample(spark, tmp_path):
    df = spark.createDataFrame([(k * 37 % 1000, str(k)) for k in range(1000)], "x int, s string").repartition(5)
    P.write_sorted(df, f"{tmp_path}/t", ["x"], rows_per_task=200)
    files = [r["x"] for r in spark.read.parquet(f"{tmp_path}/t").withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list("x").alias("x")).orderBy("f").collect()]
    assert len(files) >= 4 and [x for f in files for x in f] == sorted(x for f in files for x in f)
    s = [r.position for r in P.sample_positions(df, ["x"], 100, "1").collect()]
    assert len(set(s)) == 100 and 300 < np.mean(s) < 700 and s != [r.position for r in P.sample_positions(df, ["x"], 100, "2").collect()]


def test_buckets_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(str(g) if g else None, float(v)) for g, v in zip(rng.integers(0, 3, 3000), rng.normal(size=3000), strict=True)]
    df, ps = spark.createDataFrame(rows, "g string, x double"), [0.0, 0.1, 0.5, 0.99, 1.0]
    monkeypatch.setattr(O, "SMALL", 100)
    monkeypatch.setattr(O, "DIRECT", 0)
    for r in O.quantiles(df, "x", ps, ["g"]).collect():
        assert np.allclose(r["q"], np.quantile([x for g, x in rows if g == r["g"]], ps))
    assert np.allclose(O.quantiles(df, "x", ps, []).first()["q"], np.quantile([x for _, x in rows], ps))


@pytest.mark.parametrize(("pivots", "chunk"), [(1, 7), (5, 20_000), (40, 11)])
def test_neighbours_equal_brute_force(spark, pivots, chunk):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5)) * 6
    v = [[float(x) for x in centres[k % 6] + rng.normal(size=5)] for k in range(240)]
    v[7] = v[11] = v[13]  # ties
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)] + [(999, None)], "id long, v array<double>")
    found, seen = V.search(V.build(df, "v", "id", pivots, chunk), df.where("id % 10 in (1, 3)"), "v", "id", 6)
    got = {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in found.collect()}
    a = np.array(v)
    for q in (k for k in range(240) if k % 10 in (1, 3)):
        d = np.sqrt(((a - a[q]) ** 2).sum(1))
        best = sorted((x, k) for k, x in enumerate(d) if k != q)[:6]
        assert [got[q, i + 1][0] for i in range(6)] == [k for _, k in best] and np.allclose([got[q, i + 1][1] for i in range(6)], [x for x, _ in best])
    if pivots == 40:  # the index leaves most pairs out
        assert seen.agg(F.sum("seen")).first()[0] < 0.5 * 48 * 240
    few, _ = V.search(V.build(df.limit(3), "v", "id", 2), df.limit(3), "v", "id", 9)
    assert few.count() == 6


def test_states_merge_to_the_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k % 3), float(x) if k % 50 else float("nan")) for k, x in enumerate(np.round(rng.lognormal(size=9000), 2))] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    days = [df.where(F.pmod(F.xxhash64("g", "x"), F.lit(4)) == k) for k in range(4)]
    held = K.state(days[0], ["g"], "x")
    for day in days[1:]:
        held = K.updated(held, day, ["g"], "x")
    whole = {r["g"]: r for r in K.estimates(K.state(df, ["g"], "x"), ["g"], [0.1, 0.5, 0.9]).collect()}
    for r in K.estimates(held, ["g"], [0.1, 0.5, 0.9]).collect():
        x, w = np.array([v for g, v in rows if g == r["g"] and v is not None and v == v]), whole[r["g"]]
        assert (r["n"], r["low"], r["high"]) == (w["n"], w["low"], w["high"])
        if not len(x):
            assert r["n"] == 0 and r["mean"] is None and r["quantiles"] is None
            continue
        assert np.allclose((r["n"], r["mean"], r["std"], r["low"], r["high"]), (len(x), x.mean(), x.std(), x.min(), x.max()))
        for p, q in zip((0.1, 0.5, 0.9), r["quantiles"], strict=True):
            assert (x < q).mean() - 0.02 <= p <= (x <= q).mean() + 0.02
        assert abs(r["n_distinct"] / len(set(x)) - 1) < 0.05


def test_ledger_keeps_one_copy(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 2, f"r{k}") for k in range(20)], "id int, part int, s string")
    led = Ledger(spark, f"{tmp_path}/t", ["part"])
    assert led.batches() == [] and led.todo(df, ["id"]).count() == 20
    assert led.append(df.where("id < 8"), "day1") and not led.append(df.where("id < 8"), "day1")
    # A job that dies between writing and recording leaves nothing to see; running it again gives one copy.
    real, Ledger._record = Ledger._record, lambda self, batch, state: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        led.append(df.where("id >= 8").union(df.limit(3)), "day2")
    Ledger._record = real
    assert led.read().count() == 8 and sorted(r.id for r in led.todo(df, ["id"]).collect()) == list(range(8, 20))
    assert led.append(led.todo(df, ["id"]), "day2")
    assert sorted(r.id for r in led.read().collect()) == list(range(20)) and led.todo(df, ["id"]).count() == 0
    # Of two writers that both got as far as recording, one does.
    assert not led._record("day2", {"rows": 0})
    assert led.verify() == {} and led.manifest("day1")["partitions"] == {json.dumps(["0"]): 4, json.dumps(["1"]): 4}
    df.limit(1).drop("part").write.mode("append").parquet(f"{tmp_path}/t/data/batch=day1/part=0")
    assert led.verify() == {"day1": ["rows", "digest", "partitions"]}
    with pytest.raises(ValueError, match="id"):
        led.append(df, "a/b")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(500).select((F.col("id") % 7).alias("e"), F.col("id").alias("t"), F.rand(1).alias("x"))
        a, b = io.write_bucketed(df, f"{tmp_path}/a", ["e", "t"], 4), io.write_bucketed(df.withColumnRenamed("x", "y"), f"{tmp_path}/b", ["e", "t"], 4)
        j = a.join(b, ["e", "t"])
        assert j.count() == 500 and "Exchange" not in j._jdf.queryExecution().executedPlan().toString()
        g = a.groupBy("e", "t").count()
        assert "Exchange" not in g._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_draws_have_their_moments(spark):
    df = spark.range(20_000)
    for shape, scale in ((0.4, 2.0), (1.0, 3.0), (7.5, 0.5)):
        a = df.select("id", E.gamma("g", shape, scale, F.col("id")).alias("x"))
        b = {r.id: r.x for r in df.repartition(9).select("id", E.gamma("g", shape, scale, F.col("id")).alias("x")).where("id < 50").collect()}
        m = a.agg(F.avg("x"), F.var_pop("x"), F.min("x")).first()
        assert abs(m[0] / (shape * scale) - 1) < 0.05 and abs(m[1] / (shape * scale**2) - 1) < 0.12 and m[2] > 0
        assert {r.id: r.x for r in a.where("id < 50").collect()} == b
    for mean in (0.3, 4.0, 60.0):
        m = df.select(E.poisson(E.uniform("p", F.col("id")), mean).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
        assert abs(m[0] / mean - 1) < 0.05 and abs(m[1] / mean - 1) < 0.08
    z = E.normal(E.uniform("a", F.col("id")), E.uniform("b", F.col("id")))
    m = df.select(F.log(E.lognormal(z, 1.0, 0.5)).alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(m[0] - 1) < 0.02 and abs(m[1] - 0.5) < 0.02


def test_folds_are_balanced(spark):
    rng = np.random.default_rng(5)
    sizes = {k: int(n) for k, n in enumerate(rng.zipf(1.6, 60)) if n < 400}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "e int")
    got = E.balanced_folds(df, "e", 4).collect()
    assert {r.e: r.n for r in got} == sizes
    total = [sum(r.n for r in got if r.fold == f) for f in range(4)]
    assert max(total) - min(total) <= max(sizes.values())


def test_probes_find_a_planted_signal(spark):
    rng = np.random.default_rng(6)
    rows = []
    for e in range(60):
        for _ in range(10):
            y = int(rng.integers(0, 2))
            rows.append((e, y, float(rng.normal() + 2.5 * y), float(rng.normal() + 0.6 * y), float(rng.normal())))
    df = spark.createDataFrame(rows, "e int, y int, strong double, weak double, none double").cache()
    auc = {m: probes.probe(df, ["strong", "weak", "none"], "y", "e", 2, m).agg(F.avg("auc")).first()[0] for m in ("linear", "trees")}
    assert auc["linear"] > 0.93 and auc["trees"] > 0.9
    assert 0.4 < probes.probe(df, ["none"], "y", "e", 2).agg(F.avg("auc")).first()[0] < 0.6
    got = {(r.kind, r.feature): r.auc for r in probes.ablation(df, ["none", "strong", "weak"], "y", "e").collect()}
    assert got["alone", "strong"] > got["alone", "weak"] > got["alone", "none"]
    assert ("cumulative", "weak") in got and got["all", ""] == got["cumulative", "none"] and got["without", "strong"] < got["without", "weak"]
    # Folds keep an entity together.
    assert probes.with_folds(df, "e", 3).groupBy("e").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
