"""Queries on encodings, splits, samples and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import distribution as D
from ..operators import encode as E
from ..operators import grid as G
from .registry import OBS, query, table


def _r(x, n: int = 6):
    return F.round(x, n)


def _bucket_sql(key: str, n: int) -> str:
    return f"list_reduce(list_transform(string_split(sha256({key}), ''), lambda c: strpos('0123456789abcdef', c)::BIGINT - 1), lambda a, c: (a * 16 + c) % {n}, 0::BIGINT)"


#: What has no ASCII form without its accents is dropped before the runs are replaced.
_NORM = r"regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]+', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT doc_id, {_NORM.format(x='text')} AS item, {_NORM.format(x='source')} AS src FROM documents")
def enc_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", S.normalize_item(F.col("text")).alias("item"), S.normalize_item(F.col("source")).alias("src"))


_WIDE = """p AS (SELECT p_partkey AS id, p_size, p_retailprice, p_type, p_brand, CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS large, p_partkey % 20 < 17 AS train FROM part),
s AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mr, stddev_pop(p_retailprice) AS sr FROM p WHERE train),
tok AS (SELECT id, 'p_size' AS item, 'continuous' AS kind, (p_size - ms) / ss AS value FROM p, s UNION ALL SELECT id, 'p_retailprice', 'continuous', (p_retailprice - mr) / sr FROM p, s
  UNION ALL SELECT id, 'large', 'binary', 1.0 FROM p WHERE large = 'yes' UNION ALL SELECT id, 'p_type:' || """ + _NORM.format(x="p_type") + ", 'categorical', 1.0 FROM p)"


def _tokens(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id").withColumn("large", F.when(F.col("p_size") > 25, "yes").otherwise("no"))
    stats = E.train_stats(p, ["p_size", "p_retailprice"], F.col("id") % 20 < 17)
    return p, E.emit_tokens(p, "id", ["p_size", "p_retailprice"], ["large"], ["p_type"], stats)


@query(f"WITH {_WIDE} SELECT id, item, kind, round(value, 6) AS value FROM tok")
def enc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)[1].withColumn("value", _r("value"))


@query("SELECT p_brand AS raw, CASE WHEN count(*) FILTER (p_partkey % 20 < 17) >= 70 THEN " + _NORM.format(x="p_brand") + " ELSE 'other' END AS item, count(*) FILTER (p_partkey % 20 < 17)::BIGINT AS n_train FROM part GROUP BY p_brand")
def enc_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return E.vocabulary(table(spark, d, "part"), "p_brand", F.col("p_partkey") % 20 < 17, 70)


@query(
    f"""WITH {_WIDE}, c AS (SELECT DISTINCT id, id % 3 AS g FROM p), i AS (SELECT DISTINCT item FROM tok UNION ALL SELECT 'never'), nc AS (SELECT g, count(*) AS n_cases FROM c GROUP BY g),
n AS (SELECT item, g, count(DISTINCT id) AS n_emitted FROM tok JOIN c USING (id) WHERE NOT (item = 'large' AND g = 1) GROUP BY 1, 2)
SELECT item, g, n_cases::BIGINT AS n_cases, coalesce(n_emitted, 0)::BIGINT AS n_emitted, round(coalesce(n_emitted, 0) / n_cases, 9) AS fraction, CASE WHEN n_emitted IS NULL THEN 1 END AS mask FROM i CROSS JOIN nc LEFT JOIN n USING (item, g)"""
)
def enc_coverage(spark: SparkSession, d: str) -> DataFrame:
    p, tok = _tokens(spark, d)
    cases = p.select("id", (F.col("id") % 3).alias("g"))
    seen = tok.join(cases, "id").where(~((F.col("item") == "large") & (F.col("g") == 1))).select(*tok.columns)
    items = tok.select("item").unionByName(spark.createDataFrame([("never",)], "item string"))
    return E.token_coverage(seen, cases, "id", "g", items).withColumn("fraction", _r("fraction", 9))


@query(f"WITH {_WIDE} SELECT id, round(coalesce(max(value) FILTER (item = 'p_size'), 0), 6) AS p_size, coalesce(max(value) FILTER (item = 'large'), 0)::DOUBLE AS large FROM tok GROUP BY id")
def enc_matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.to_matrix(_tokens(spark, d)[1], "id", ["p_size", "large"]).withColumn("p_size", _r("p_size"))


@query(f"WITH {_WIDE} SELECT id, (max(value) FILTER (item = 'large'))::DOUBLE AS large, round(max(value) FILTER (item = 'p_retailprice'), 6) AS p_retailprice, (max((item = 'large')::INT) + max((item = 'p_retailprice')::INT))::INT AS n_ctx FROM tok GROUP BY id")
def enc_context_vector(spark: SparkSession, d: str) -> DataFrame:
    return E.context_vector(_tokens(spark, d)[1], "id", ["large", "p_retailprice"]).withColumn("p_retailprice", _r("p_retailprice"))


@query(
    """SELECT p_partkey, trim(coalesce(CASE WHEN p_partkey % 5 = 0 THEN ' NaN ' WHEN p_partkey % 7 = 0 THEN 'None' ELSE p_size::VARCHAR END, '')) AS raw,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS number, (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AS missing, least(greatest(p_size, 5), 40)::DOUBLE AS clipped, ln(1 + p_size) > 3 AS high FROM part"""
)
def fn_coercion(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 5 == 0, " NaN ").when(F.col("p_partkey") % 7 == 0, "None").otherwise(F.col("p_size").cast("string"))
    p = table(spark, d, "part").withColumn("raw", raw)
    return p.select("p_partkey", F.trim("raw").alias("raw"), S.to_number(F.trim("raw")).alias("number"), S.is_missing(F.col("raw")).alias("missing"), S.clip(F.col("p_size").cast("double"), 5, 40).alias("clipped"), (F.log1p("p_size") > 3).alias("high"))


@query(
    r"""SELECT event_id, coalesce(props->>'$.missing', props->>'$.k')::DOUBLE AS k, regexp_extract('t=' || value || 's: raise to ' || value || ' mcg/min', '^t=([0-9.]+)s', 1)::DOUBLE AS t, round(value / 1000, 9) AS mg FROM events"""
)
def fn_json_regex(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit("t="), F.col("value").cast("string"), F.lit("s: raise to "), F.col("value").cast("string"), F.lit(" mcg/min"))
    e = table(spark, d, "events").withColumn("note", note)
    return e.select("event_id", S.to_number(S.field(F.col("props"), "missing", "k")).alias("k"), S.time_in_text(F.col("note")).alias("t"), _r(S.number_in(F.col("note")), 9).alias("mg"))


@query(
    """SELECT event_id, round(CASE event_type WHEN 'click' THEN value / 60 WHEN 'view' THEN value * 60 ELSE value END, 6) AS rate, round(pow(value, 2) / (pow(value, 2) + 400), 9) AS hill, round(100 - 60 * value / (value + 20), 6) AS emax,
  round(1 / (1 + exp((value - 20) * 0.1)), 9) AS attenuation, round(1 / (23400 / (greatest(value, 0.1) ** 3 + 150 * greatest(value, 0.1)) + 1), 9) AS saturation, round(0.21 * 713 - value / 0.8, 6) AS alveolar,
  round(1.1 * 80 - 128 * (80 / (150 + value / 10)) ** 2, 6) AS lean, round(value * pow(80 / 70, 0.75), 6) AS scaled FROM events"""
)
def fn_models(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    unit = F.when(F.col("event_type") == "click", "/h").when(F.col("event_type") == "view", "/s").otherwise("/min")
    return table(spark, d, "events").select(
        "event_id", _r(S.per_minute(v, unit)).alias("rate"), _r(S.hill(v, 20, 2), 9).alias("hill"), _r(S.emax(v, 100, 40, 20)).alias("emax"), _r(S.attenuation(v, 20, 0.1), 9).alias("attenuation"),
        _r(S.saturation(v), 9).alias("saturation"), _r(S.alveolar_oxygen(F.lit(0.21), v)).alias("alveolar"), _r(S.lean_mass(F.lit(80.0), 150 + v / 10, F.lit(True))).alias("lean"), _r(S.scaled(v, F.lit(80.0))).alias("scaled"),
    )


@query(
    """SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding[1:8]::DOUBLE[]), 6) AS head, round(list_sum(embedding[57:64]::DOUBLE[]), 6) AS tail FROM embeddings"""
)
def fn_arrays(spark: SparkSession, d: str) -> DataFrame:
    part = lambda a: _r(F.aggregate(F.slice("embedding", a, 8), F.lit(0.0), lambda s, x: s + x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), part(1).alias("head"), part(57).alias("tail"))


@query("""SELECT p_partkey, coalesce(h BETWEEN 50 AND 230 AND w BETWEEN 2 AND 300 AND abs(w / pow(h / 100, 2) - b) / b <= 0.05, NULL) AS ok FROM
  (SELECT p_partkey, 140.0::DOUBLE + p_size AS h, p_retailprice / 15 AS w, 25 + p_partkey % 5 AS b FROM part)""")
def fn_coherence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", E.coherent(140.0 + F.col("p_size"), F.col("p_retailprice") / 15, 25 + F.col("p_partkey") % 5).alias("ok"))


@query(f"SELECT user_id, {_bucket_sql('user_id::VARCHAR', 100)} AS b, CASE WHEN {_bucket_sql('user_id::VARCHAR', 100)} < 85 THEN 'train' ELSE 'val' END AS split FROM (SELECT DISTINCT user_id FROM events)")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select("user_id").distinct()
    return u.select("user_id", S.bucket(F.col("user_id"), 100).alias("b"), E.split_of(F.col("user_id")).alias("split"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sha256('7:' || event_id)) <= 40")
def split_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.sample_per_group(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], F.col("event_id"), 40, "7")


@query(
    """WITH u AS (SELECT DISTINCT user_id FROM events ORDER BY sha256('a:' || user_id) LIMIT 20) SELECT event_id, user_id FROM events JOIN u USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256('b:' || event_id)) <= 5"""
)
def split_case_then_cell(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    users = e.select("user_id").distinct().orderBy(F.sha2(F.concat(F.lit("a:"), F.col("user_id").cast("string")), 256)).limit(20)
    return E.sample_per_group(e.join(F.broadcast(users), "user_id", "left_semi"), ["user_id"], F.col("event_id"), 5, "b").select("event_id", "user_id")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= round(0.3 * count(*) OVER (PARTITION BY c_mktsegment)) AS picked FROM customer")
def split_quota(spark: SparkSession, d: str) -> DataFrame:
    return E.quota(table(spark, d, "customer"), ["c_mktsegment"], ["c_custkey"], F.lit(0.3)).select("c_custkey", "picked")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('f:' || event_id)) % 5 AS fold FROM events")
def split_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return E.stratified_folds(table(spark, d, "events"), ["event_type"], F.col("event_id")).select("event_id", "fold")


@query(
    "SELECT event_id, ('0x' || sha256('s:' || event_id)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u, round(-ln(1 - ('0x' || sha256('s:' || event_id)[1:13])::BIGINT / 4503599627370496.0::DOUBLE) * 30, 6) AS e FROM events"
)
def split_uniform_draws(spark: SparkSession, d: str) -> DataFrame:
    u = E.uniform("s", F.col("event_id"))
    return table(spark, d, "events").select("event_id", u.alias("u"), _r(E.exponential(u, 30.0)).alias("e"))


# --- distributions -----------------------------------------------------------------------------------------------------

_CDF = f"""{OBS}, n AS (SELECT track, value AS x, count(*) FILTER (entity % 2 = 0) AS a, count(*) FILTER (entity % 2 = 1) AS b FROM obs GROUP BY 1, 2),
c AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb, lead(x) OVER (PARTITION BY track ORDER BY x) AS nx FROM n
  WINDOW w AS (PARTITION BY track ORDER BY x ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY track))"""


@query(f"WITH {_CDF} SELECT track, round(sum(abs(ca / na - cb / nb) * (nx - x)), 6) AS wasserstein, round(max(abs(ca / na - cb / nb)), 9) AS ks, round(sum(a * (cb - b / 2)) / max(na * nb), 9) AS auc FROM c GROUP BY track")
def dist_w1_ks_auc(spark: SparkSession, d: str) -> DataFrame:
    o = G.observations(table(spark, d, "events"))
    r = D.distances(o, "value", F.col("entity") % 2 == 0, ["track"])
    return r.select("track", _r("wasserstein").alias("wasserstein"), _r("ks", 9).alias("ks"), _r("auc", 9).alias("auc"))


@query(
    """WITH v AS (SELECT n_chars::DOUBLE AS x, quality = 1 AS s FROM documents JOIN labels USING (doc_id)), n AS (SELECT x, count(*) FILTER (s) AS a, count(*) FILTER (NOT s) AS b FROM v GROUP BY x),
c AS (SELECT *, sum(b) OVER (ORDER BY x) AS cb FROM n) SELECT round(sum(a * (cb - b / 2)) / (sum(a) * sum(b)), 9) AS auc FROM c"""
)
def dist_label_auc(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x")).join(table(spark, d, "labels"), "doc_id")
    return D.distances(v, "x", F.col("quality") == 1, []).select(_r("auc", 9).alias("auc"))


@query(
    """WITH n AS (SELECT coalesce(CASE WHEN user_id % 9 = 0 THEN NULL ELSE event_type END, '<none>') AS c, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT round(sum(abs(a / (SELECT sum(a) FROM n) - b / (SELECT sum(b) FROM n))) / 2, 9) AS tvd FROM n"""
)
def dist_total_variation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("c", F.when(F.col("user_id") % 9 != 0, F.col("event_type")))
    return D.total_variation(e, "c", F.col("user_id") % 2 == 0).select(_r("tvd", 9).alias("tvd"))


_MI_E = "list_distinct(quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))"


@query(
    f"""WITH v AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), e AS (SELECT {_MI_E.format(c="x")} AS ex, {_MI_E.format(c="y")} AS ey FROM v),
b AS (SELECT len(list_filter(ex, lambda a: a <= x)) AS bx, len(list_filter(ey, lambda a: a <= y)) AS "by", count(*) AS n FROM v, e GROUP BY 1, 2)
SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM (SELECT n::DOUBLE AS n, (sum(n) OVER (PARTITION BY bx))::DOUBLE AS nx, (sum(n) OVER (PARTITION BY "by"))::DOUBLE AS ny, (sum(n) OVER ())::DOUBLE AS t FROM b)"""
)
def dist_mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return D.mutual_information(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(_r("mi").alias("mi"))


@query(
    """WITH c AS (SELECT l_linestatus = 'F' AS s, corr(l_quantity, l_extendedprice) AS r1, corr(l_quantity, l_discount) AS r2, corr(l_extendedprice, l_discount) AS r3 FROM lineitem GROUP BY 1),
d AS (SELECT max(r1) FILTER (s) - max(r1) FILTER (NOT s) AS d1, max(r2) FILTER (s) - max(r2) FILTER (NOT s) AS d2, max(r3) FILTER (s) - max(r3) FILTER (NOT s) AS d3 FROM c),
l AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, d1 AS x FROM d UNION ALL SELECT 'l_quantity', 'l_discount', d2 FROM d UNION ALL SELECT 'l_extendedprice', 'l_discount', d3 FROM d)
SELECT a, b, round(x, 6) AS difference, round(sqrt(2 * sum(x * x) OVER ()), 6) AS norm FROM l"""
)
def dist_correlation_difference(spark: SparkSession, d: str) -> DataFrame:
    r = D.correlation_difference(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], F.col("l_linestatus") == "F")
    return r.select("a", "b", _r("difference").alias("difference"), _r("norm").alias("norm"))


@query(
    f"""WITH {OBS}, c AS (SELECT track, quantile_cont(value, 0.99) AS cut FROM obs WHERE entity % 2 = 1 GROUP BY track)
SELECT track, round(cut, 6) AS cut, count(*)::BIGINT AS n, round(avg((value > cut)::INT), 9) AS above FROM obs JOIN c USING (track) WHERE entity % 2 = 0 GROUP BY track, cut"""
)
def dist_tail_exceedance(spark: SparkSession, d: str) -> DataFrame:
    t = D.tail_exceedance(G.observations(table(spark, d, "events")), "value", F.col("entity") % 2 == 0, ["track"])
    return t.select("track", _r("cut").alias("cut"), "n", _r("above", 9).alias("above"))


@query(
    "WITH c AS (SELECT quality AS t, count(*) AS n, count(*) FILTER (quality = 1 - toxic) AS hit FROM labels GROUP BY 1) SELECT round(sum(hit) / sum(n), 9) AS accuracy, round(avg(hit / n), 9) AS balanced_accuracy FROM c"
)
def dist_accuracy(spark: SparkSession, d: str) -> DataFrame:
    a = D.accuracy(table(spark, d, "labels").withColumn("guess", 1 - F.col("toxic")), "quality", "guess")
    return a.select(_r("accuracy", 9).alias("accuracy"), _r("balanced_accuracy", 9).alias("balanced_accuracy"))


_NN = """p AS (SELECT q.vec_id AS query, q.label AS label, b.vec_id AS id, b.label AS other, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM p QUALIFY rank <= 20)"""


@query(f"WITH {_NN}, s AS (SELECT query, label, avg((other <> label)::INT) AS share FROM t GROUP BY 1, 2) SELECT label, count(*)::BIGINT AS n, round(avg(share), 6) AS mean, round(quantile_cont(share, 0.5), 6) AS median FROM s GROUP BY label")
def dist_neighbour_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = D.neighbour_overlap(table(spark, d, "embeddings"), "embedding", "vec_id", "label", 20, 100)
    return o.select("label", "n", _r("mean").alias("mean"), _r("median").alias("median"))


@query(
    """WITH e AS (SELECT label < 5 AS s, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT dim, s, avg(x) AS m, var_samp(x) AS v FROM e GROUP BY 1, 2),
d AS (SELECT dim, max(m) FILTER (s) - max(m) FILTER (NOT s) AS d, sum(v) AS v FROM m GROUP BY dim) SELECT round(sqrt(sum(d * d)) / sqrt(sum(v) / 2), 6) AS separation FROM d"""
)
def dist_centroid_separation(spark: SparkSession, d: str) -> DataFrame:
    return D.centroid_separation(table(spark, d, "embeddings"), "embedding", F.col("label") < 5).select(_r("separation").alias("separation"))


@query(
    """WITH e AS (SELECT l_quantity AS k, 1 - coalesce(sum(n) OVER (ORDER BY l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS a, 1.0::DOUBLE / l_quantity AS b
  FROM (SELECT l_quantity, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1))
SELECT min(k) FILTER (a < 0.3 AND b < 0.5) AS first_k, (SELECT bool_and(a <= p) FROM (SELECT a, lag(a, 1, 2.0) OVER (ORDER BY k) AS p FROM e)) AS monotone FROM e"""
)
def dist_first_below(spark: SparkSession, d: str) -> DataFrame:
    """The quantity from which on less than 30 % of the lines are as large, and whether that share never rises."""
    c = D.cumulated(table(spark, d, "lineitem"), "l_quantity", F.lit(True), [])
    e = c.select(F.col("x").alias("k"), (1 - (F.col("ca") - F.col("a")) / F.col("na")).alias("a"), (1 / F.col("x")).alias("b"))
    return D.first_below(e.withColumns({"a": F.col("a") / 0.3, "b": F.col("b") / 0.5}), "k", ["a", "b"], 1.0)


@query(f"WITH {_NN} SELECT query, id, rank::INT AS rank, round(d, 6) AS distance FROM t")
def dist_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest of all vectors to each hundredth one, by the metric index."""
    from ..operators import vector_index as V

    e = table(spark, d, "embeddings")
    found, _ = V.search(V.build(e, "embedding", "vec_id"), e.where("vec_id % 100 = 0"), "embedding", "vec_id", 20)
    return found.select("query", "id", "rank", _r("distance").alias("distance"))


@query(
    """SELECT l_returnflag, count(l_extendedprice)::BIGINT AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 3) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  true AS median_within, true AS distinct_within FROM lineitem GROUP BY l_returnflag"""
)
def agg_sketches(spark: SparkSession, d: str) -> DataFrame:
    """States of three parts of the lines merged, with the estimates' errors: the median's rank within 2 %, the distinct count within 5 %."""
    from ..operators import sketches as K

    li, g, x = table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"
    parts = [li.where(F.pmod(F.col("l_orderkey"), F.lit(3)) == k) for k in range(3)]
    held = K.updated(K.updated(K.state(parts[0], g, x), parts[1], g, x), parts[2], g, x)
    e = K.estimates(held, g, [0.5]).withColumn("q", F.col("quantiles")[0])
    true = li.join(F.broadcast(e.select(*g, "q")), g).groupBy(*g).agg((F.count_if(F.col(x) <= F.col("q")) / F.count(x)).alias("rank"), F.count_distinct(x).alias("d"))
    rows = e.join(true, g)
    return rows.select(
        *g, "n", _r("mean", 4).alias("mean"), _r("std", 3).alias("std"), "low", "high",
        (F.abs(F.col("rank") - 0.5) <= 0.02).alias("median_within"), (F.abs(F.col("n_distinct") / F.col("d") - 1) <= 0.05).alias("distinct_within"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END NULLS FIRST, l_orderkey, l_linenumber) - 1 AS position FROM lineitem"""
)
def ord_positions(spark: SparkSession, d: str) -> DataFrame:
    """The position of each line in the order of a column with few values and many nulls, then of the key."""
    from ..operators.positions import positions

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("q"))
    return positions(li, ["q", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "position")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) - 1 AS position FROM lineitem)
SELECT * FROM p ORDER BY sha256('7:' || position) LIMIT 500"""
)
def ord_sample(spark: SparkSession, d: str) -> DataFrame:
    """500 lines at positions drawn from all, each as likely as any other."""
    from ..operators.positions import sample_positions

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sample_positions(li, ["l_quantity", "l_orderkey", "l_linenumber"], 500, "7").drop("l_quantity")


@query(
    """WITH u AS (SELECT event_id, ('0x' || sha256('p:' || event_id)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM events),
c AS (SELECT k, sum(exp(k * ln(4.5) - 4.5 - lgamma(k + 1))) OVER (ORDER BY k) AS s FROM (SELECT unnest(range(0, 60))::DOUBLE AS k))
SELECT event_id, (SELECT count(*) FROM c WHERE s < u)::INT AS k FROM u"""
)
def split_poisson_draws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", E.poisson(E.uniform("p", F.col("event_id")), 4.5).alias("k"))


@query(
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256('f:' || user_id)) - 1 AS p FROM n)
SELECT user_id, n::BIGINT AS n, (CASE WHEN p // 5 % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END)::INT AS fold FROM p"""
)
def split_balanced_folds(spark: SparkSession, d: str) -> DataFrame:
    return E.balanced_folds(table(spark, d, "events"), "user_id")


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i <= vec_id % 65 THEN x::DOUBLE ELSE 0 END)), 6) AS head, len(embedding)::INT AS n FROM embeddings"""
)
def fn_prefix_mask(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("p", E.prefix_mask(F.col("embedding").cast("array<double>"), (F.col("vec_id") % 65).cast("int")))
    return e.select("vec_id", _r(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("head"), F.size("p").alias("n"))


@query("SELECT count(*)::BIGINT AS n, round(avg(abs(l_quantity * 1.005 - l_quantity) / l_quantity), 9) AS error, count(*) > 10 AND avg(abs(l_quantity * 1.005 - l_quantity) / l_quantity) < 0.01 AS passed FROM lineitem WHERE l_quantity > 0.1")
def dist_relative_error(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_quantity") * 1.005).alias("a"), F.col("l_quantity").alias("b"))
    return D.relative_error(li, "a", "b").withColumn("error", _r("error", 9))


@query("SELECT event_id, round(coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, avg(CASE WHEN event_id % 7 <> 0 THEN value END) OVER ()), 6) AS x FROM events")
def dist_impute_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))
    return D.impute_mean(e, ["x"]).withColumn("x", _r("x"))


@query(
    """WITH v AS (SELECT event_type, value AS y, lag(value) OVER w AS m, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_type, round(avg(abs(y - m)), 6) AS mae, round(avg(abs(y - b)), 6) AS mae_baseline, round(avg(abs(y - m)) / nullif(avg(abs(y - b)), 0), 6) AS ratio FROM v GROUP BY 1"""
)
def dist_mae_ratio(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, d, "events").select("event_type", F.col("value").alias("y"), F.lag("value").over(w).alias("m"), F.avg("value").over(w.rowsBetween(-5, -1)).alias("b"))
    r = D.mae_ratio(v, "y", "m", "b", ["event_type"])
    return r.select("event_type", *(_r(c).alias(c) for c in ("mae", "mae_baseline", "ratio")))
