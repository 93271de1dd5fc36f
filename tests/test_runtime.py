"""Sources, streams, generation, and the entry module."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelloom.sources import io
from panelloom.streaming import streams


def test_round_trip_and_manifest(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("p"), (F.col("id") % 7).alias("e"), F.col("id").alias("t"))
    path = f"file://{tmp_path}/t"
    io.write_partitioned(df, path, ["p"], "e", ["t"], max_records=10)
    back = spark.read.parquet(path)
    assert io.table_hash(back.select("e", "t", F.col("p").cast("long").alias("p"))).first() == io.table_hash(df).first()
    m = io.manifest(back, ["p"], {"step": 5})
    assert m["rows"] == 100 and sum(m["partitions"].values()) == 100
    io.write_json(spark, m, f"file://{tmp_path}/m")
    assert io.read_documents(spark, f"file://{tmp_path}/m").first()["rows"] == 100


def test_projection_and_cache(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    assert io.read_projected(spark, f"{tmp_path}/x", {"id": "int", "no": "string"}).dtypes == [("id", "int"), ("no", "string")]
    calls = []
    make = lambda: calls.append(1) or spark.range(2)
    for _ in range(2):
        assert io.cached(spark, f"{tmp_path}/c", {"v": 1}, make).count() == 2
    assert len(calls) == 1
    assert io.not_done(spark.range(5), spark.range(3), "id").count() == 2
    assert len(io.folder_sha256(tmp_path)) == 64


def test_config():
    c = io.PanelConfig(step_s=2.5, seed="x")
    assert io.PanelConfig.from_yaml(c.to_yaml()) == c
    with pytest.raises(KeyError):
        io.PanelConfig.from_yaml("nope: 1")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-{1 + i % 9:02d} 0{i % 10}:00:00", "a" if i % 2 else "b", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    s = streams.file_stream(spark, f"file://{tmp_path}/s", 1)
    got = streams.drain(streams.window_counts(s, ["event_type"], "1 day"), "t", "complete")
    want = streams.window_counts(df, ["event_type"], "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert streams.session_counts(df, ["user_id"], "2 hours").agg(F.sum("n")).first()[0] == 60
    assert streams.first_seen(df, ["user_id"]).count() == 3


def test_entry_has_sql_for_known_queries_only(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100
