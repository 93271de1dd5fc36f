"""Queries on sources, streams and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import probes
from ..sources import io
from ..sources.ledger import Ledger
from ..streaming import streams
from .registry import query, table


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS total, NULL::DOUBLE AS absent FROM lineitem GROUP BY 1, 2")
def src_partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """Written by partition, read back with a projection that asks for a column the table lacks."""
    path = io.scratch(spark, "partitioned")
    io.write_partitioned(table(spark, d, "lineitem").drop("l_shipdate"), path, ["l_returnflag", "l_linestatus"], "l_orderkey", ["l_linenumber"])
    back = io.read_projected(spark, path, {"l_returnflag": "string", "l_linestatus": "string", "l_quantity": "double", "absent": "double"})
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"), F.max("absent").alias("absent"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def src_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return io.partition_counts(table(spark, d, "lineitem"), ["l_returnflag"])


@query(
    """SELECT source, "column" FROM (VALUES ('nation', 'n_nationkey'), ('nation', 'n_name'), ('nation', 'n_regionkey'), ('region', 'r_regionkey'), ('region', 'r_name'),
  ('labels', 'doc_id'), ('labels', 'quality'), ('labels', 'toxic')) v(source, "column")"""
)
def src_schema_inventory(spark: SparkSession, d: str) -> DataFrame:
    return io.schema_inventory(spark, {t: f"{d}/{t}.parquet" for t in ("nation", "region", "labels")}).select("source", "column")


@query("SELECT n_nationkey, n_name FROM nation")
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    path = io.scratch(spark, "csv")
    io.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return io.read_csv(spark, path, "n_nationkey int, n_name string")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def src_json_documents(spark: SparkSession, d: str) -> DataFrame:
    path = io.scratch(spark, "json")
    table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props")).write.json(path)
    return spark.read.schema("event_id long, props struct<k: long>").json(path).select("event_id", F.col("props.k").alias("k"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def src_union_relaxed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return io.union_relaxed([c, s])


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def src_resume(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return io.not_done(o, o.where("o_orderstatus = 'P'"), "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, sha256(p_name || chr(31) || p_brand || chr(31) || p_size) AS h FROM part")
def src_row_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", io.row_sha256(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("h"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """A file stream through a tumbling window, drained."""
    s = streams.window_counts(streams.file_stream(spark, f"{d}/events.parquet"), ["event_type"], "6 hours")
    out = streams.drain(s, "tumbling", "complete")
    return out.select("event_type", G.wall_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query(
    """SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - o * 21600000000 AS start_us, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY 1, 2"""
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """A file stream through overlapping windows, drained."""
    s = streams.window_counts(streams.file_stream(spark, f"{d}/events.parquet"), ["event_type"], "24 hours", "6 hours")
    out = streams.drain(s, "sliding", "complete")
    return out.select("event_type", G.wall_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 28800000000 AS end_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, s"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A file stream through session windows, drained."""
    s = streams.session_counts(streams.file_stream(spark, f"{d}/events.parquet"), ["user_id"], "8 hours")
    out = streams.drain(s, "sessions", "complete")
    return out.select("user_id", G.wall_micros("start").alias("start_us"), G.wall_micros("end").alias("end_us"), "n")


@query(
    """SELECT a.event_id, a.user_id, CASE WHEN epoch_us(a.ts) - epoch_us(b.ts) <= 172800000000 THEN b.value END AS held
FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts > b.ts"""
)
def stream_asof_state(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase before each event, kept as state of a stream that corrects itself, so that files may come in any order."""
    s = streams.asof_previous(streams.file_stream(spark, f"{d}/events.parquet"), "user_id", "event_type", "purchase", 172_800.0)
    return streams.drain(s, "asof", latest="event_id").select("event_id", "user_id", "held")


@query()
def probe_linear(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("label", (F.col("l_linestatus") == "F").cast("int"))
    return probes.probe(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "label", "l_orderkey", 3)


@query()
def probe_trees(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("label", (F.col("l_extendedprice") > 50_000).cast("int"))
    return probes.probe(li, ["l_quantity", "l_discount"], "label", "l_orderkey", 2, "trees")


@query()
def probe_ablation(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("label", (F.col("l_extendedprice") > 50_000).cast("int"))
    return probes.ablation(li, ["l_quantity", "l_discount"], "label", "l_orderkey")


@query(
    """SELECT o_orderstatus, 'b' || (o_orderkey % 3)::INT AS batch, count(*)::BIGINT AS n, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY o_orderstatus, o_orderkey % 3"""
)
def src_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Three batches appended, one of them twice, one after a try that died before it was recorded, one with fewer columns."""
    o, led = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), Ledger(spark, io.scratch(spark, "ledger"), ["o_orderstatus"])
    part = [o.where(F.col("o_orderkey") % 3 == k) for k in range(3)]
    part[1].write.parquet(f"{led.path}/data/batch=b1")  # rows that no ledger knows
    done = [led.append(part[0], "b0"), led.append(part[0], "b0"), led.append(part[1], "b1"), led.append(part[2].drop("o_totalprice"), "b2")]
    if done != [True, False, True, True] or led.verify():
        raise ValueError(f"batches aren't as recorded: {done}")
    return led.read().groupBy("o_orderstatus", "batch").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    """SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_extendedprice * (1 - b.l_discount) AS net
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_linenumber <= 2"""
)
def src_colocated_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of the same composite key, bucketed and sorted by it: joined without a shuffle of either."""
    li, key = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    a = io.write_bucketed(li.where("l_linenumber <= 2").select(*key, "l_quantity"), io.scratch(spark, "left"), key, 8)
    b = io.write_bucketed(li.select(*key, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")), io.scratch(spark, "right"), key, 8)
    return a.join(b.hint("merge"), key)


@query(
    """SELECT kind, count(*)::BIGINT AS n, count(amount)::BIGINT AS n_amount, count(note)::BIGINT AS n_note, round(sum(amount), 2) AS total FROM (
  SELECT 'customer' AS kind, c_acctbal::DOUBLE AS amount, c_mktsegment AS note FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', NULL, p_brand FROM part) GROUP BY kind"""
)
def src_merged_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of differing schemas under one path, read as one table: each has some of the columns."""
    path = io.scratch(spark, "merged")
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").cast("double").alias("amount"), F.col("c_mktsegment").alias("note"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").cast("double").alias("amount"), F.lit("supplier").alias("kind"))
    p = table(spark, d, "part").select(F.col("p_brand").alias("note"), F.lit("part").alias("kind"))
    for k, part in enumerate((c, s, p)):
        part.write.parquet(f"{path}/{k}")
    rows = io.read_projected(spark, [f"{path}/{k}" for k in range(3)], {"kind": "string", "amount": "double", "note": "string"}, merge=True)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("amount").alias("n_amount"), F.count("note").alias("n_note"), F.round(F.sum("amount"), 2).alias("total"))
