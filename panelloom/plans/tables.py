"""Queries on aggregates and relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import grid as G
from ..operators import relational as R
from .registry import OBS, query, table


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return G.observations(table(spark, d, "events"))


def _r(x, n: int = 6):
    return F.round(x, n)


@query(
    "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(nullif(stddev_pop(l_quantity), 0), 1), 6) AS std, "
    "round(avg(l_discount) FILTER (l_quantity > 10), 6) AS masked, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM lineitem GROUP BY 1, 2"
)
def agg_mean_std(spark: SparkSession, d: str) -> DataFrame:
    m, s = A.mean_std("l_quantity")
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), _r(m).alias("mean"), _r(s).alias("std"), _r(A.masked_mean(F.col("l_discount"), (F.col("l_quantity") > 10).cast("int"))).alias("masked"),
        F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
    )


_QS = ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{round(100 * q):02d}" for q in A.QUANTILES)


@query(f"WITH {OBS} SELECT track, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, {_QS} FROM obs GROUP BY track")
def agg_marginals(spark: SparkSession, d: str) -> DataFrame:
    m = A.marginals(_obs(spark, d), ["track"], "value")
    return m.select("track", "n", *(_r(c).alias(c) for c in m.columns if c not in ("track", "n")))


@query(
    f"""WITH {OBS}, q AS (SELECT *, round_even(value / 5, 0) * 5 AS x FROM obs), d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY entity, track ORDER BY t, seq)) AS d FROM q)
SELECT track, count(x)::BIGINT AS n, count(DISTINCT x)::BIGINT AS n_distinct, round(avg((abs(x - round_even(x, 0)) <= 1e-6)::INT), 6) AS frac_int, min(d) FILTER (d > 1e-9) AS min_increment, round(avg((d = 0)::INT), 6) AS frac_unchanged FROM d GROUP BY track"""
)
def agg_quantization(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumn("x", G.quantize(F.col("value"), 5.0))
    q = A.quantization(o, ["entity", "track"], ["track"], ["t", "seq"], "x")
    return q.select("track", "n", "n_distinct", _r("frac_int").alias("frac_int"), "min_increment", _r("frac_unchanged").alias("frac_unchanged"))


@query(
    """WITH u AS (UNPIVOT (SELECT l_linestatus, l_quantity, l_discount, l_quantity * 0 AS zero, CASE WHEN l_linestatus = 'F' THEN l_tax END AS tax_f FROM lineitem) ON l_quantity, l_discount, zero, tax_f INTO NAME col VALUE value),
u2 AS (SELECT l_linestatus, 'tax_f' AS col, NULL::DOUBLE AS value FROM lineitem WHERE l_linestatus <> 'F' UNION ALL SELECT l_linestatus, col, value FROM u)
SELECT l_linestatus, col, count(*)::BIGINT AS n, sum((value IS NULL)::INT)::BIGINT AS n_null, coalesce(min(value) = max(value), false) AS "constant", coalesce(min(value) = 0 AND max(value) = 0, false) AS all_zero FROM u2 GROUP BY 1, 2"""
)
def agg_column_audit(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumns({"zero": F.col("l_quantity") * 0, "tax_f": F.when(F.col("l_linestatus") == "F", F.col("l_tax"))})
    return A.column_audit(li, ["l_linestatus"], ["l_quantity", "l_discount", "zero", "tax_f"])


@query(f"WITH {OBS}, e AS (SELECT track, entity, avg((value > 20)::INT) AS m FROM obs GROUP BY 1, 2) SELECT track, count(m)::BIGINT AS n_entities, round(avg(m), 9) AS macro FROM e GROUP BY track")
def agg_macro_average(spark: SparkSession, d: str) -> DataFrame:
    m = A.macro_average(_obs(spark, d), ["entity"], ["track"], (F.col("value") > 20).cast("int"))
    return m.select("track", "n_entities", _r("macro", 9).alias("macro"))


@query(
    """SELECT event_type AS track, count(DISTINCT user_id) FILTER (value > 60)::BIGINT AS n_entities, round(count(DISTINCT user_id) FILTER (value > 60) / (SELECT count(DISTINCT user_id) FROM events WHERE value > 60), 9) AS prevalence FROM events WHERE value > 60 GROUP BY 1"""
)
def agg_prevalence(spark: SparkSession, d: str) -> DataFrame:
    p = A.prevalence(_obs(spark, d).where("value > 60"), "entity", "track")
    return p.select("track", "n_entities", _r("prevalence", 9).alias("prevalence"))


@query(
    """SELECT n_name AS nation, seg AS segment, count(c_custkey)::BIGINT AS n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer)
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey AND c_mktsegment = seg GROUP BY 1, 2"""
)
def agg_coverage_table(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation")), table(spark, d, "customer")
    facts = c.where("c_acctbal > 9000").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("nation", F.col("c_mktsegment").alias("segment"))
    return A.coverage_table(facts, n.select("nation"), c.select(F.col("c_mktsegment").alias("segment")).distinct(), "nation", "segment")


@query(
    """WITH u AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON COLUMNS(*) INTO NAME col VALUE value) SELECT col, count(value)::BIGINT AS n, round(sum(value), 4) AS total, round(sum(value * value), 4) AS squares FROM u GROUP BY col"""
)
def agg_checksums(spark: SparkSession, d: str) -> DataFrame:
    c = A.checksums(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return c.select("col", "n", _r("total", 4).alias("total"), _r("squares", 4).alias("squares"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return A.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT CASE WHEN n >= 1985 THEN e.event_type ELSE 'other' END AS event_type, count(*)::BIGINT AS n FROM events e JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c USING (event_type) GROUP BY 1")
def agg_rare_to_other(spark: SparkSession, d: str) -> DataFrame:
    return A.rare_to_other(table(spark, d, "events"), "event_type", 1985).groupBy("event_type").agg(F.count("*").alias("n"))


_EDGES = "e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM v)"
_BINNED = f"""v AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), {_EDGES},
b AS (SELECT x, y, e, len(list_filter(e, lambda a: a <= x))::INT - 1 AS bin FROM v, e),
curve AS (SELECT bin, (e[bin + 1] + e[bin + 2]) / 2 AS centre, count(*)::BIGINT AS n, avg(y) AS mean FROM b WHERE bin BETWEEN 0 AND len(e) - 2 GROUP BY bin, centre HAVING count(*) >= 10)"""


@query(f"WITH {_BINNED} SELECT bin, round(centre, 6) AS centre, n, round(mean, 4) AS mean FROM curve")
def agg_bin_means(spark: SparkSession, d: str) -> DataFrame:
    b = A.bin_means(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return b.select("bin", _r("centre").alias("centre"), "n", _r("mean", 4).alias("mean"))


@query(
    f"""WITH {_BINNED}, q AS (SELECT unnest(range(0, 56, 5))::DOUBLE AS x),
s AS (SELECT q.x, (SELECT max(centre) FROM curve WHERE centre <= q.x) AS lo, (SELECT min(centre) FROM curve WHERE centre >= q.x) AS hi FROM q)
SELECT s.x, round(CASE WHEN lo IS NULL THEN h.mean WHEN hi IS NULL THEN l.mean WHEN hi > lo THEN l.mean + (s.x - lo) * ((h.mean - l.mean) / (hi - lo)) ELSE l.mean END, 4) AS y
FROM s LEFT JOIN curve l ON l.centre = lo LEFT JOIN curve h ON h.centre = hi"""
)
def agg_interpolated_curve(spark: SparkSession, d: str) -> DataFrame:
    c = A.bin_means(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.col("centre").alias("x"), F.col("mean").alias("y"))
    at = spark.range(0, 56, 5).select(F.col("id").cast("double").alias("x"))
    return A.interpolate(c, at).select("x", _r("y", 4).alias("y"))


@query("PIVOT (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) ON l_linestatus IN ('F', 'O') USING round(coalesce(avg(l_quantity), 0), 6) GROUP BY l_returnflag")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(_r(F.avg("l_quantity")))
    return p.fillna(0.0)


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(ln(1 + l_extendedprice)) AS ml, stddev_pop(ln(1 + l_extendedprice)) AS sl FROM lineitem WHERE l_orderkey % 20 < 17)
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::VARCHAR AS d, round(CASE WHEN l_discount >= 0.02 THEN (l_quantity - m) / s ELSE 0 END, 6) AS q, round((ln(1 + l_extendedprice) - ml) / sl, 5) AS p FROM lineitem, s"""
)
def norm_train_stats(spark: SparkSession, d: str) -> DataFrame:
    """log1p and z-scores with statistics of the training rows; masked values are exactly 0."""
    li = table(spark, d, "lineitem").withColumns({"q": F.col("l_quantity"), "p": F.col("l_extendedprice"), "lp": F.log1p("l_extendedprice"), "mask": (F.col("l_discount") < 0.02).cast("int")})
    stats = A.fit_normalization(li, ["q", "lp"], F.col("l_orderkey") % 20 < 17)
    out = A.normalize(li, stats, ["q", "lp"], {"q": "mask"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("d"), _r("q").alias("q"), F.round("lp", 5).alias("p"))


@query(
    f"""WITH {OBS}, d AS (SELECT track, entity, value - lag(value) OVER (PARTITION BY entity, track ORDER BY t, seq) AS dv, lead(value, 3) OVER (PARTITION BY entity, track ORDER BY t, seq) - value AS d3 FROM obs)
SELECT track, count(dv)::BIGINT AS n, round(avg(dv), 6) AS mean_delta, round(avg(abs(d3)), 6) AS persistence_3 FROM d GROUP BY track"""
)
def agg_lag_deltas(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("entity", "track").orderBy("t", "seq")
    o = _obs(spark, d).select("track", (F.col("value") - F.lag("value").over(w)).alias("dv"), (F.lead("value", 3).over(w) - F.col("value")).alias("d3"))
    return o.groupBy("track").agg(F.count("dv").alias("n"), _r(F.avg("dv")).alias("mean_delta"), _r(F.avg(F.abs("d3"))).alias("persistence_3"))


# --- relational ------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def rel_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return R.without_keys(R.only_keys(o, c.where("c_mktsegment = 'BUILDING'"), ["o_custkey"]), c.where("c_acctbal < 0"), ["o_custkey"])


@query(
    """WITH p AS (SELECT user_id AS entity, user_id // 2 AS pair FROM events GROUP BY 1), hit AS (SELECT pair FROM p WHERE entity % 11 = 0)
SELECT event_id, user_id AS entity FROM events JOIN p ON user_id = entity WHERE pair NOT IN (SELECT pair FROM hit)"""
)
def rel_exclude_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("entity"))
    pairs = e.select("entity", F.floor(F.col("entity") / 2).alias("pair")).distinct()
    return R.exclude_whole_pairs(e, pairs.where("entity % 11 = 0"), pairs, "entity", "pair")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def rel_left_counts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.left_counts(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"])


_IV = f"{OBS}, iv AS (SELECT entity, t AS \"start\", t + 3600 * (1 + seq % 40) AS \"end\", value AS v, seq FROM obs WHERE track = 'purchase'), pt AS (SELECT seq AS row, entity, t FROM obs WHERE track = 'view')"


def _iv(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _obs(spark, d)
    iv = o.where("track = 'purchase'").select("entity", F.col("t").alias("start"), (F.col("t") + 3600 * (1 + F.col("seq") % 40)).alias("end"), F.col("value").alias("v"), "seq")
    return o.where("track = 'view'").select(F.col("seq").alias("row"), "entity", "t"), iv


@query(f"WITH {_IV} SELECT row, seq, v FROM pt JOIN iv ON pt.entity = iv.entity AND t BETWEEN \"start\" AND \"end\"")
def rel_point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    pt, iv = _iv(spark, d)
    return R.intervals_at(pt, iv, ["entity"], 86_400.0).select("row", "seq", "v")


@query(f"WITH {_IV} SELECT row, coalesce(max_by(v, seq), -1.0) AS v FROM pt LEFT JOIN iv ON pt.entity = iv.entity AND t BETWEEN \"start\" AND \"end\" GROUP BY row")
def rel_last_writer(spark: SparkSession, d: str) -> DataFrame:
    pt, iv = _iv(spark, d)
    return R.last_writer(pt, iv, ["entity"], "row", "v", "seq", F.lit(-1.0), 86_400.0)


@query(f"WITH {_IV} SELECT row, coalesce(min_by(v, seq), 0.0) AS v FROM pt LEFT JOIN iv ON pt.entity = iv.entity AND t BETWEEN \"start\" AND \"end\" GROUP BY row")
def rel_rate_at(spark: SparkSession, d: str) -> DataFrame:
    """The first interval over a point wins; 0 without one."""
    pt, iv = _iv(spark, d)
    return R.last_writer(pt, iv, ["entity"], "row", "v", "seq", F.lit(0.0), 86_400.0, last=False)


@query(
    f"""WITH {OBS}, a AS (SELECT entity, t AS "start", lead(t) OVER (PARTITION BY entity ORDER BY t, seq) AS "end", CASE WHEN value < 5 THEN 0 ELSE value END AS rate FROM obs WHERE track = 'purchase'),
pt AS (SELECT seq AS row, entity, t FROM obs WHERE track = 'view')
SELECT row, coalesce(max_by(rate, "start"), 0.0) AS last_rate, coalesce(min_by(rate, "start"), 0.0) AS first_rate, count(rate)::INT > 0 AS covered
FROM pt LEFT JOIN a ON pt.entity = a.entity AND t >= "start" AND (t <= "end" OR "end" IS NULL) AND rate > 0 GROUP BY row"""
)
def rel_open_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Rates set by purchases hold until the next one, the last of an entity for ever."""
    o = _obs(spark, d)
    acts = o.where("track = 'purchase'").withColumn("rate", F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")))
    iv = R.actions_to_intervals(acts, ["entity"], ["t", "seq"], "t", "rate")
    pt = o.where("track = 'view'").select(F.col("seq").alias("row"), "entity", "t")
    last = R.last_writer(pt, iv, ["entity"], "row", "rate", "start", F.lit(0.0), 3600.0).withColumnRenamed("rate", "last_rate")
    first = R.last_writer(pt, iv, ["entity"], "row", "rate", "start", F.lit(0.0), 3600.0, last=False).withColumnRenamed("rate", "first_rate")
    over = R.covered(pt, iv, ["entity"], "row", 3600.0).select("row", (F.col("covered") == 1).alias("covered"))
    return last.join(first, "row").join(over, "row")


@query(
    f"""WITH {OBS}, e AS (SELECT *, value > 8 AS o, lag(value > 8) OVER w AS p FROM obs WINDOW w AS (PARTITION BY entity ORDER BY t, seq)),
i AS (SELECT *, sum((o AND NOT coalesce(p, false))::INT) OVER (PARTITION BY entity ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT entity, island::BIGINT AS island, min(t) AS "start", max(t) AS stop, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM i WHERE o GROUP BY 1, 2"""
)
def rel_islands(spark: SparkSession, d: str) -> DataFrame:
    return R.islands(_obs(spark, d), ["entity"], ["t", "seq"], F.col("value") > 8, x="value").withColumn("mean", _r("mean"))


@query(f"WITH {OBS}, a AS (SELECT entity, t AS \"start\", lead(t) OVER (PARTITION BY entity, track ORDER BY t, seq) AS \"end\", CASE WHEN value < 5 THEN 0 ELSE value END AS rate, track FROM obs) SELECT entity, track, \"start\", \"end\", rate FROM a WHERE rate > 0")
def rel_actions_to_intervals(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumn("rate", F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")))
    return R.actions_to_intervals(o, ["entity", "track"], ["t", "seq"], "t", "rate")


@query(
    f"""WITH {_IV}, cuts AS (SELECT entity, t AS cut FROM obs WHERE track = 'error'),
p AS (SELECT entity, seq AS id, "start" AS p, "end" FROM iv UNION SELECT iv.entity, seq, cut, "end" FROM iv JOIN cuts ON cuts.entity = iv.entity AND cut > "start" AND cut < "end")
SELECT entity, id, p AS "start", coalesce(lead(p) OVER (PARTITION BY entity, id ORDER BY p), "end") AS "end" FROM p"""
)
def rel_split_intervals(spark: SparkSession, d: str) -> DataFrame:
    _, iv = _iv(spark, d)
    cuts = _obs(spark, d).where("track = 'error'").select("entity", F.col("t").alias("cut"))
    return R.split_intervals(iv.select("entity", F.col("seq").alias("id"), "start", "end"), cuts, ["entity"], 86_400.0)


_DUP = "dup AS (SELECT l_orderkey AS id, round(l_extendedprice * 100)::BIGINT AS seq, CASE WHEN l_quantity > 25 THEN l_quantity END AS a, CASE WHEN l_discount > 0.04 THEN l_discount END AS b, CASE WHEN l_tax > 0.03 THEN l_returnflag END AS c FROM lineitem)"


def _dup(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    some = lambda c, x, low: F.when(F.col(c) > low, F.col(x))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("seq"), some("l_quantity", "l_quantity", 25).alias("a"), some("l_discount", "l_discount", 0.04).alias("b"), some("l_tax", "l_returnflag", 0.03).alias("c"), *more
    )


@query(
    f"""WITH {_DUP} SELECT id, seq, a, b, c FROM dup QUALIFY row_number() OVER (PARTITION BY id ORDER BY (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT DESC, seq, a, b, c) = 1"""
)
def rel_dedup_most_complete(spark: SparkSession, d: str) -> DataFrame:
    return R.most_complete(_dup(spark, d), ["id"], ["a", "b", "c"], "seq").select("id", "seq", "a", "b", "c")


@query(f"WITH {_DUP} SELECT id, max(seq) AS seq, arg_max(a IS NULL, seq) AS a_null FROM dup GROUP BY id")
def rel_dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    # arg_max keeps the first of equal rows in the table's order, and skips rows without seq
    rows = _dup(spark, d, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    kept = R.keep_first(rows, ["id"], ["seq"], last=True, ties=("file", "row"))
    return kept.select("id", "seq", F.when(F.col("seq").isNotNull(), F.col("a").isNull()).alias("a_null"))


@query(
    f"""WITH {_DUP} SELECT id, count(*)::BIGINT AS n, list_filter([CASE WHEN count(DISTINCT a) + max((a IS NULL)::INT) > 1 THEN 'a' END, CASE WHEN count(DISTINCT b) + max((b IS NULL)::INT) > 1 THEN 'b' END,
  CASE WHEN count(DISTINCT c) + max((c IS NULL)::INT) > 1 THEN 'c' END], lambda x: x IS NOT NULL) AS differing FROM dup GROUP BY id HAVING count(*) > 1"""
)
def rel_differing_columns(spark: SparkSession, d: str) -> DataFrame:
    return R.differing_columns(_dup(spark, d), ["id"], ["a", "b", "c"])


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 5000) DESC, c_custkey LIMIT 10")
def rel_top_abs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") - 5000).alias("x"))
    return R.top_abs(c, "x", "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS regionkey, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_suppkey::INT, s_name, NULL, s_acctbal FROM supplier")
def rel_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    s = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("int").alias("k"))
    return n.unionByName(s, allowMissingColumns=True)


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'both' AS part, k FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'only_a', k FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'only_b', k FROM (FROM b EXCEPT FROM a)"""
)
def rel_set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in ("F", "P"))
    tag = lambda df, t: df.select(F.lit(t).alias("part"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "only_a")).unionByName(tag(b.exceptAll(a), "only_b"))


_CMP = """a AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x, value * 2 AS y FROM events),
b AS (SELECT event_id AS id, user_id, CASE WHEN event_id % 14 = 0 THEN NULL WHEN event_id > 5000 THEN value + 0.5 ELSE value END AS x, value * 2 AS y FROM events WHERE event_id % 1000 <> 999)"""


def _ab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, v = table(spark, d, "events").withColumnRenamed("event_id", "id"), F.col("value")
    a = e.select("id", "user_id", F.when(F.col("id") % 7 != 0, v).alias("x"), (v * 2).alias("y"))
    b = e.where("id % 1000 <> 999").select("id", "user_id", F.when(F.col("id") % 14 == 0, None).when(F.col("id") > 5000, v + 0.5).otherwise(v).alias("x"), (v * 2).alias("y"))
    return a, b


def _cmp_sql(where: str) -> str:
    one = """SELECT '{c}' AS col, count(*)::BIGINT AS n, sum((a.id IS NULL OR b.id IS NULL OR a.{c} IS DISTINCT FROM b.{c})::INT)::BIGINT AS n_differ,
  sum((a.id IS NOT NULL AND b.id IS NOT NULL AND (a.{c} IS NULL) <> (b.{c} IS NULL))::INT)::BIGINT AS n_pattern, round(max(abs(a.{c} - b.{c})), 9) AS max_abs
  FROM (SELECT * FROM a WHERE {w}) a FULL JOIN (SELECT * FROM b WHERE {w}) b ON a.id = b.id"""
    return f"WITH {_CMP} " + " UNION ALL ".join(one.format(c=c, w=where) for c in "xy")


@query(_cmp_sql("true"))
def cmp_tables(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ab(spark, d)
    return R.compare_tables(a, b, ["id"], ["x", "y"]).withColumn("max_abs", _r("max_abs", 9))


@query(_cmp_sql("id < 5000"))
def cmp_prefix(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ab(spark, d)
    return R.compare_tables(a, b, ["id"], ["x", "y"], F.col("id") < 5000).withColumn("max_abs", _r("max_abs", 9))


@query(
    """WITH v AS (SELECT l_quantity AS x, 3 * l_quantity + 7 + l_discount AS y FROM lineitem), f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM v)
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, count(*)::BIGINT AS n, round(max(abs(y - slope * x - intercept)), 6) AS max_residual FROM v, f GROUP BY slope, intercept"""
)
def cmp_affine_fit(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (3 * F.col("l_quantity") + 7 + F.col("l_discount")).alias("y"))
    f = R.affine_fit(v, "x", "y")
    return f.select(_r("slope").alias("slope"), _r("intercept").alias("intercept"), "n", _r("max_residual").alias("max_residual"))


@query(f"WITH {_CMP} SELECT (coalesce(abs(a.x - b.x) <= 0.1, a.x IS NULL AND b.x IS NULL)) AS same, count(*)::BIGINT AS n FROM a JOIN b USING (id) GROUP BY 1")
def cmp_tolerance(spark: SparkSession, d: str) -> DataFrame:
    a, b = _ab(spark, d)
    j = a.select("id", "x").join(b.select("id", F.col("x").alias("z")), "id")
    return j.groupBy(R.close(F.col("x"), F.col("z"), 0.1).alias("same")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {OBS}, w AS (SELECT entity, round(avg(t)) AS at FROM obs GROUP BY entity)
SELECT w.entity, w.at, s.value FROM w ASOF LEFT JOIN (SELECT * FROM obs WHERE track = 'click') s ON w.entity = s.entity AND w.at >= s.t"""
)
def rel_value_at(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d)
    return R.value_at(o.where("track = 'click'"), o.groupBy("entity").agg(F.round(F.avg("t")).alias("at")), ["entity"])


@query(f"WITH {OBS} SELECT entity, sum((i > 1 AND track IS DISTINCT FROM p)::INT)::BIGINT AS n_changes FROM (SELECT entity, track, lag(track) OVER w AS p, row_number() OVER w AS i FROM obs WINDOW w AS (PARTITION BY entity ORDER BY t, seq)) GROUP BY entity")
def rel_changes(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).select("entity", R.changed("track", ["entity"], ["t", "seq"]).alias("c"))
    return o.groupBy("entity").agg(F.count_if("c").alias("n_changes"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'small' WHEN p_name LIKE '%ring' THEN 'ring' WHEN contains(p_name, 'dg') THEN 'dg' WHEN regexp_matches(p_type, '^(ECO|PRO)') THEN 'eco_pro' ELSE 'rest' END AS label FROM part")
def rel_classify(spark: SparkSession, d: str) -> DataFrame:
    p = R.check_columns(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), {"p_partkey", "p_name", "p_type"})
    name = R.classify(F.col("p_name"), [("starts", "small", "small"), ("ends", "ring", "ring"), ("holds", "dg", "dg")], "")
    kind = R.classify(F.col("p_type"), [("like", "^(ECO|PRO)", "eco_pro")], "rest")
    return p.select("p_partkey", F.when(name != "", name).otherwise(kind).alias("label"))


# --- by type, at horizons, by marks ----------------------------------------------------------------------------------------


@query(
    """WITH j AS (SELECT o_orderkey AS id, o_orderpriority AS s1, CASE WHEN o_orderkey % 7 = 0 THEN upper(o_orderpriority) || '!' WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS s2,
  o_custkey AS n1, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS n2 FROM orders)
SELECT 's' AS col, count(*)::BIGINT AS n, count(*) FILTER (s1 IS DISTINCT FROM s2)::BIGINT AS n_differ, count(*) FILTER ((s1 IS NULL) <> (s2 IS NULL))::BIGINT AS n_pattern,
  CASE WHEN count(*) FILTER ((s1 IS NULL) <> (s2 IS NULL)) > 0 THEN 'inf'::DOUBLE END AS max_abs FROM j
UNION ALL SELECT 'n', count(*), count(*) FILTER (n1 IS DISTINCT FROM n2), count(*) FILTER ((n1 IS NULL) <> (n2 IS NULL)),
  CASE WHEN count(*) FILTER ((n1 IS NULL) <> (n2 IS NULL)) > 0 THEN 'inf'::DOUBLE ELSE max(abs(n1 - n2)) END FROM j"""
)
def cmp_types(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("s"), F.col("o_custkey").alias("n"))
    s = F.when(F.col("id") % 7 == 0, F.concat(F.upper("s"), F.lit("!"))).when(F.col("id") % 11 != 0, F.col("s"))
    n = F.when(F.col("id") % 5 == 0, F.col("n") + 1).when(F.col("id") % 13 != 0, F.col("n"))
    return R.compare_tables(o, o.select("id", s.alias("s"), n.alias("n")), ["id"], ["s", "n"], pattern_inf=True)


@query(
    f"""WITH {OBS}, w AS (SELECT track, value AS x, lead(value, 1) OVER p AS a, lead(value, 12) OVER p AS b, lead(value, 60) OVER p AS c FROM obs WINDOW p AS (PARTITION BY entity, track ORDER BY t, seq)),
u AS (SELECT track, 1 AS horizon, abs(a - x) AS e FROM w UNION ALL SELECT track, 12, abs(b - x) FROM w UNION ALL SELECT track, 60, abs(c - x) FROM w)
SELECT track, horizon, count(e)::BIGINT AS n, round(avg(e), 6) AS mae FROM u GROUP BY 1, 2"""
)
def agg_persistence(spark: SparkSession, d: str) -> DataFrame:
    p = A.persistence_error(_obs(spark, d), ["entity", "track"], ["t", "seq"], "value", group=["track"])
    return p.withColumn("mae", _r("mae"))


@query(
    f"""WITH {OBS}, o AS (SELECT entity, min(t) AS lo, max(t) AS hi FROM obs GROUP BY entity),
m AS (SELECT entity, min(t) FILTER (track = 'purchase') AS s, max(t) FILTER (track = 'error') AS e, CASE WHEN entity % 3 = 0 THEN 0.0 ELSE max(t) FILTER (track = 'purchase') END AS c FROM obs GROUP BY entity)
SELECT entity, greatest(s, lo) AS a0, least(e, CASE WHEN c > 0 THEN c END, hi) AS a1 FROM o JOIN m USING (entity)"""
)
def grid_case_bounds(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d)
    at = lambda f, k: f(F.when(F.col("track") == k, F.col("t")))
    m = o.groupBy("entity").agg(at(F.min, "purchase").alias("ane_start"), at(F.max, "error").alias("ane_end"), F.when(F.col("entity") % 3 == 0, F.lit(0.0)).otherwise(at(F.max, "purchase")).alias("case_end"))
    return G.case_bounds(o, m.withColumn("case_start", F.lit(None).cast("double")), ["entity"])


@query(
    """WITH c AS (SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT g, n, n * 37 / sum(n) OVER () AS q FROM c),
r AS (SELECT g, n, floor(q)::BIGINT AS f, row_number() OVER (ORDER BY round(floor(q) - q, 12), n DESC, g) AS i FROM q)
SELECT g, n::BIGINT AS n, f + (i <= 37 - (SELECT sum(f) FROM r))::BIGINT AS take FROM r"""
)
def split_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    from panelloom.operators import encode as E

    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.count("*").alias("n"))
    return E.largest_remainder(c, ["g"], "n", 37)


@query("SELECT p_partkey, p_type FROM part WHERE split_part(p_type, ' ', 1) IN ('STANDARD', 'PROMO', 'SMALL')")
def enc_scope(spark: SparkSession, d: str) -> DataFrame:
    from panelloom.operators import encode as E

    return E.in_scope(table(spark, d, "part").select("p_partkey", "p_type"), ("STANDARD", "PROMO", "SMALL"), "p_type", " ")
