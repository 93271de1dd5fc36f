"""Queries on grids and sliding windows over the events table: entity = user, track = event type, 6 h cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import windows as W
from ..sources import io
from .registry import GRID, OBS, query, table

STEP = 21_600
#: Tolerances by track in seconds; others have the default.
MAX_AGE, DEFAULT_AGE = {"click": 86_400.0, "error": 172_800.0, "purchase": 259_200.0}, 43_200.0


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return G.observations(table(spark, d, "events"))


def _grid(obs: DataFrame) -> DataFrame:
    return G.make_grid(G.bounds(obs, ["entity"], STEP), STEP)


def _tolerances(spark: SparkSession) -> DataFrame:
    rows = [(k, MAX_AGE.get(k, DEFAULT_AGE)) for k in ("click", "error", "purchase", "signup", "view")]
    return F.broadcast(spark.createDataFrame(rows, "track string, max_age double"))  # a row a track


def _filled(spark: SparkSession, d: str) -> DataFrame:
    obs = _obs(spark, d)
    points = _grid(obs).join(_tolerances(spark))
    return G.ffill_asof(obs, points, ["entity", "track"], F.col("max_age"), seq="seq", bucket=7 * 86_400)


_TRACKS = "tr(track, max_age) AS (VALUES ('click', 86400.0::DOUBLE), ('error', 172800.0::DOUBLE), ('purchase', 259200.0::DOUBLE), ('signup', 43200.0::DOUBLE), ('view', 43200.0::DOUBLE))"
_FILLED = f"""WITH {OBS}, {GRID}, {_TRACKS},
filled AS (SELECT g.entity, g.track, g.k, g.t, CASE WHEN g.t - s.t <= max_age THEN s.value END AS value,
    (coalesce(g.t - s.t <= max_age, false))::INT AS present
  FROM (SELECT * FROM grid, tr) g ASOF LEFT JOIN obs s ON g.entity = s.entity AND g.track = s.track AND g.t >= s.t)
"""


@query(_FILLED + "SELECT entity, track, count(*)::BIGINT AS n_cells, round(avg(present), 9) AS coverage, round(sum(value), 4) AS total FROM filled GROUP BY entity, track")
def asof_ffill_grid(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: as-of fill with a tolerance for each track, and coverage."""
    return _filled(spark, d).groupBy("entity", "track").agg(F.count("*").alias("n_cells"), F.round(F.avg("present"), 9).alias("coverage"), F.round(F.sum("value"), 4).alias("total"))


@query(_FILLED + "SELECT entity, track, k, value, present FROM filled")
def grid_asof_rows(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select("entity", "track", "k", "value", "present")


@query(
    f"""WITH {OBS}, {GRID}
SELECT g.entity, g.k, s.value, g.t - s.t AS age FROM grid g ASOF LEFT JOIN (SELECT * FROM obs WHERE track = 'purchase') s ON g.entity = s.entity AND g.t >= s.t"""
)
def grid_hold(spark: SparkSession, d: str) -> DataFrame:
    """Held without a limit of age; null before the first sample."""
    obs = _obs(spark, d)
    return G.ffill_asof(obs.where("track = 'purchase'"), _grid(obs), ["entity"], seq="seq").select("entity", "k", "value", "age")


@query(
    f"""WITH {OBS}, {GRID},
b AS (SELECT o.entity, greatest(0, ceil((o.t - a0) / 21600))::INT AS k, round(sum(value), 4) AS total
  FROM obs o JOIN bnd USING (entity) WHERE value > 0 AND greatest(0, ceil((o.t - a0) / 21600)) < ceil((a1 - a0) / 21600) GROUP BY 1, 2)
SELECT g.entity, g.k, coalesce(b.total, 0) AS total FROM grid g LEFT JOIN b USING (entity, k)"""
)
def grid_bin_events(spark: SparkSession, d: str) -> DataFrame:
    obs = _obs(spark, d)
    b = G.bounds(obs, ["entity"], STEP)
    sums = G.bin_events(obs, b, ["entity"], STEP)
    return G.make_grid(b, STEP).join(sums, ["entity", "k"], "left").select("entity", "k", F.coalesce(F.round("total", 4), F.lit(0.0)).alias("total"))


@query(
    f"""WITH {OBS}, {GRID}
SELECT entity, ceil((t - a0) / 21600 - 0.5)::INT AS k, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM obs JOIN bnd USING (entity) GROUP BY 1, 2"""
)
def grid_nearest_stamp(spark: SparkSession, d: str) -> DataFrame:
    """Events added to their nearest grid point."""
    obs = _obs(spark, d)
    rows = obs.join(G.bounds(obs, ["entity"], STEP), "entity").withColumn("k", G.nearest_cell(F.col("t"), F.col("a0"), STEP))
    return rows.groupBy("entity", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_TRIM = _FILLED + """, w AS (SELECT entity, k, max(present) FILTER (track = 'view') AS m1, max(present) FILTER (track = 'signup') AS m2 FROM filled GROUP BY entity, k),
e AS (SELECT *, min(k) FILTER (greatest(m1, m2) > 0) OVER p AS lo, max(k) FILTER (greatest(m1, m2) > 0) OVER p AS hi FROM w WINDOW p AS (PARTITION BY entity))
"""


@query(_TRIM + "SELECT entity, k, m1, m2, (sum((k < lo)::INT) OVER (PARTITION BY entity))::BIGINT AS n_head, (sum((k > hi)::INT) OVER (PARTITION BY entity))::BIGINT AS n_tail FROM e QUALIFY k BETWEEN lo AND hi")
def grid_trim_edges(spark: SparkSession, d: str) -> DataFrame:
    f = _filled(spark, d)
    wide = f.groupBy("entity", "k").agg(*(F.max(F.when(F.col("track") == t, F.col("present"))).alias(m) for t, m in (("view", "m1"), ("signup", "m2"))))
    return G.trim_edges(wide, ["entity"], ["m1", "m2"], "k").select("entity", "k", "m1", "m2", "n_head", "n_tail")


@query(
    f"""WITH {OBS}, d AS (SELECT entity, track, t - lag(t) OVER (PARTITION BY entity, track ORDER BY t, seq) AS d FROM obs WHERE value IS NOT NULL)
SELECT entity, track, count(*)::BIGINT AS n, max(d) AS max_gap, CASE WHEN count(*) >= 3 THEN quantile_cont(d, 0.5) END AS median_interval FROM d GROUP BY entity, track"""
)
def grid_sampling_gaps(spark: SparkSession, d: str) -> DataFrame:
    return G.sampling_gaps(_obs(spark, d), ["entity", "track"])


@query(
    f"""WITH {OBS} SELECT seq, round_even(value / 0.5, 0) * 0.5 AS half, round_even(value / 5, 0) * 5 AS five, floor(t / 300) * 300.0 AS cell FROM obs"""
)
def grid_quantize(spark: SparkSession, d: str) -> DataFrame:
    return _obs(spark, d).select("seq", G.quantize(F.col("value"), 0.5).alias("half"), G.quantize(F.col("value"), 5.0).alias("five"), G.floor_to(F.col("t"), 300).alias("cell"))


@query(
    f"""WITH {OBS}, r(track, lo, hi) AS (VALUES ('click', 1.0, 90.0), ('view', 5.0, 60.0), ('error', 0.5, 50.0), ('signup', 2.0, 80.0), ('purchase', 10.0, 200.0))
SELECT track, count(*)::BIGINT AS n, sum((value BETWEEN lo AND hi)::INT)::BIGINT AS n_plausible, round(avg((value < lo OR value > hi)::INT), 9) AS outside FROM obs JOIN r USING (track) GROUP BY track"""
)
def mask_plausible(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("click", 1.0, 90.0), ("view", 5.0, 60.0), ("error", 0.5, 50.0), ("signup", 2.0, 80.0), ("purchase", 10.0, 200.0)], "track string, lo double, hi double")
    o = _obs(spark, d).join(F.broadcast(rules), "track").withColumn("ok", G.plausible(F.col("value"), F.col("lo"), F.col("hi")))
    return o.groupBy("track").agg(F.count("*").alias("n"), F.sum("ok").alias("n_plausible"), F.round(F.avg(1 - F.col("ok")), 9).alias("outside"))


@query(
    _FILLED + """, m AS (SELECT *, CASE WHEN entity % 7 = 0 THEN NULL WHEN track = 'signup' AND entity % 2 = 0 THEN NULL ELSE value END AS x, entity % 2 AS cohort FROM filled),
c AS (SELECT *, max((x IS NOT NULL)::INT) OVER (PARTITION BY cohort, track) AS co, max((x IS NOT NULL)::INT) OVER (PARTITION BY entity, track) AS ca FROM m)
SELECT entity, track, CASE WHEN co = 0 THEN 1 WHEN ca = 0 OR x IS NULL THEN 2 ELSE 0 END AS mask, count(*)::BIGINT AS n,
  round(sum(CASE WHEN co = 1 AND ca = 1 AND x IS NOT NULL THEN x ELSE 0 END), 4) AS total FROM c GROUP BY 1, 2, 3"""
)
def mask_three_state(spark: SparkSession, d: str) -> DataFrame:
    """Seen in the cohort, the case, the cell: aggregates joined back, so no window holds a whole cohort. The filled grid is
    kept once for both uses."""
    x = F.when(F.col("entity") % 7 == 0, None).when((F.col("track") == "signup") & (F.col("entity") % 2 == 0), None).otherwise(F.col("value"))
    path = io.scratch(spark, "filled")
    _filled(spark, d).select("entity", "track", x.alias("x"), (F.col("entity") % 2).alias("cohort")).write.parquet(path)
    rows = spark.read.parquet(path)
    case = rows.groupBy("cohort", "entity", "track").agg(F.max(F.col("x").isNotNull()).alias("ca"))
    cohort = case.groupBy("cohort", "track").agg(F.max("ca").alias("co"))
    seen = case.join(cohort, ["cohort", "track"])
    m = rows.join(seen, ["cohort", "entity", "track"]).withColumn("mask", G.three_state(F.col("x"), F.col("co"), F.col("ca")))
    return m.groupBy("entity", "track", "mask").agg(F.count("*").alias("n"), F.round(F.sum(G.masked_zero(F.col("x"), F.col("mask"))), 4).alias("total"))


_WIDE = _FILLED + """, w AS (SELECT entity, k, t::BIGINT AS t, max(value) FILTER (track = 'view') AS a, max(present) FILTER (track = 'view') AS ma,
  max(value) FILTER (track = 'click') AS b, max(present) FILTER (track = 'click') AS mb, max(value) FILTER (track = 'purchase') AS c, max(present) FILTER (track = 'purchase') AS mc
  FROM filled GROUP BY entity, k, t)
"""


def _wide(spark: SparkSession, d: str) -> DataFrame:
    f = _filled(spark, d)
    pick = lambda t, c, n: F.max(F.when(F.col("track") == t, F.col(c))).alias(n)
    cols = [pick(t, c, n) for t, n in (("view", "a"), ("click", "b"), ("purchase", "c")) for c, n in (("value", n), ("present", f"m{n}"))]
    return f.groupBy("entity", "k", F.col("t").cast("long").alias("t")).agg(*cols)


@query(_WIDE + """, v AS (SELECT *, avg(ma) OVER (PARTITION BY entity) AS ca, avg(mb) OVER (PARTITION BY entity) AS cb FROM w)
SELECT entity, k, CASE WHEN ca >= 0.2 THEN 'view' WHEN cb >= 0.2 THEN 'click' ELSE 'none' END AS chosen, CASE WHEN ca >= 0.2 THEN a WHEN cb >= 0.2 THEN b END AS chosen_value,
  CASE WHEN ca >= 0.2 THEN ma WHEN cb >= 0.2 THEN mb ELSE 0 END AS chosen_mask FROM v""")
def mask_source_cascade(spark: SparkSession, d: str) -> DataFrame:
    return G.source_cascade(_wide(spark, d), ["entity"], [("view", "a", "ma"), ("click", "b", "mb")]).select("entity", "k", "chosen", "chosen_value", "chosen_mask")


@query(_WIDE + """, v AS (SELECT *, lead(a, 4) OVER p AS a1, lead(c, 4) OVER p AS c1 FROM w WINDOW p AS (PARTITION BY entity ORDER BY t))
SELECT entity, k, CASE WHEN a IS NOT NULL AND a1 IS NOT NULL THEN a WHEN c IS NOT NULL AND c1 IS NOT NULL THEN c END AS x0,
  CASE WHEN a IS NOT NULL AND a1 IS NOT NULL THEN a1 WHEN c IS NOT NULL AND c1 IS NOT NULL THEN c1 END AS x1,
  CASE WHEN a IS NOT NULL AND a1 IS NOT NULL THEN 0 WHEN c IS NOT NULL AND c1 IS NOT NULL THEN 1 ELSE 2 END AS proxy FROM v""")
def mask_endpoint_cascade(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("t")
    rows = _wide(spark, d).withColumns({"a1": F.lead("a", 4).over(w), "c1": F.lead("c", 4).over(w)})
    x0, x1, proxy = G.endpoint_cascade(F.col("a"), F.col("a1"), F.col("c"), F.col("c1"))
    return rows.select("entity", "k", x0.alias("x0"), x1.alias("x1"), proxy.alias("proxy"))


_PHASED = _WIDE + """, ph AS (SELECT *, CASE WHEN entity % 5 = 0 THEN NULL ELSE min(t) OVER p + 5 * 21600 END AS st, CASE WHEN entity % 3 = 0 THEN NULL ELSE max(t) OVER p - 8 * 21600 END AS en
  FROM w WINDOW p AS (PARTITION BY entity)),
g AS (SELECT *, CASE WHEN st IS NULL THEN 'unknown' WHEN t < st THEN 'induction' WHEN en IS NULL OR t < en THEN 'maintenance' ELSE 'emergence' END AS phase,
  CASE WHEN mb = 1 THEN 0 WHEN k % 9 = 0 THEN 1 ELSE 2 END AS st3 FROM ph WHERE NOT (entity % 4 = 1 AND k % 17 = 5))
"""


def _phased(spark: SparkSession, d: str) -> DataFrame:
    """The wide grid with phases, a three-state mask, and holes at some entities."""
    w = _wide(spark, d)
    marks = w.groupBy("entity").agg((F.min("t") + 5 * STEP).alias("st"), (F.max("t") - 8 * STEP).alias("en"))
    marks = marks.withColumns({"st": F.when(F.col("entity") % 5 != 0, F.col("st")), "en": F.when(F.col("entity") % 3 != 0, F.col("en"))})
    rows = w.join(marks, "entity").withColumn("phase", G.phase_label(F.col("t"), F.col("st"), F.col("en")))
    rows = rows.withColumn("st3", F.when(F.col("mb") == 1, 0).when(F.col("k") % 9 == 0, 1).otherwise(2))
    return rows.where(~((F.col("entity") % 4 == 1) & (F.col("k") % 17 == 5)))


@query(_PHASED + "SELECT phase, count(*)::BIGINT AS n, count(DISTINCT entity)::BIGINT AS n_entities FROM g GROUP BY phase")
def mask_phase_labels(spark: SparkSession, d: str) -> DataFrame:
    return _phased(spark, d).groupBy("phase").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"))


_FRAME = "(PARTITION BY entity ORDER BY t RANGE BETWEEN 21600 FOLLOWING AND 86400 FOLLOWING)"
_TRANS = _PHASED + f""", tw AS (SELECT entity, t AS t0, t + 86400 AS t1, phase, a AS a_t0, last(a) OVER f AS a_t1, max(b) OVER f AS b_max, round(sum(c) OVER f, 4) AS c_sum,
  CASE WHEN max((st3 = 1)::INT) OVER f = 1 THEN 1 WHEN max((st3 = 2)::INT) OVER f = 1 THEN 2 ELSE 0 END AS st3_worst, count(*) OVER f AS n, last(phase) OVER f AS p1
  FROM g WINDOW f AS {_FRAME}),
ok AS (SELECT * FROM tw WHERE n = 4 AND phase = 'maintenance' AND p1 = 'maintenance')
"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return W.transition_windows(_phased(spark, d), ["entity"], STEP, 4, ["a"], ["b"], ["c"], ["st3"], "phase")


@query(_TRANS + "SELECT entity, t0, t1, a_t0, a_t1, b_max, c_sum, st3_worst FROM ok")
def win_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).withColumn("c_sum", F.round("c_sum", 4))


@query(_TRANS + ", an AS (SELECT *, min(t0) OVER (PARTITION BY entity) AS a0 FROM ok) SELECT entity, t0, t1 > 1296000 AS post_split FROM an WHERE (t0 - a0) % 86400 = 0")
def win_anchor_stride(spark: SparkSession, d: str) -> DataFrame:
    return W.anchor_stride(_windows(spark, d), ["entity"], 86_400).select("entity", "t0", (F.col("t1") > 1_296_000).alias("post_split"))


@query(
    _TRANS + """SELECT entity, sum((n < 4)::INT)::BIGINT AS n_hole, sum((n = 4 AND phase <> 'maintenance')::INT)::BIGINT AS n_start,
  sum((n = 4 AND phase = 'maintenance' AND p1 <> 'maintenance')::INT)::BIGINT AS n_end, sum((n = 4 AND phase = 'maintenance' AND p1 = 'maintenance')::INT)::BIGINT AS n_valid FROM tw GROUP BY entity"""
)
def win_discards(spark: SparkSession, d: str) -> DataFrame:
    return W.discard_counts(_phased(spark, d), ["entity"], STEP, 4, "phase")


@query(_PHASED + "SELECT entity, t, round(avg(a) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS ma4 FROM g")
def win_moving_average(spark: SparkSession, d: str) -> DataFrame:
    return _phased(spark, d).select("entity", "t", F.round(W.moving_average("a", ["entity"], "t", 4), 6).alias("ma4"))


@query(_PHASED + "SELECT entity, t FROM (SELECT entity, t, lead(t, 11) OVER (PARTITION BY entity ORDER BY t) AS e FROM g) WHERE e - t = 11 * 21600")
def win_run_starts(spark: SparkSession, d: str) -> DataFrame:
    return W.run_starts(_phased(spark, d), ["entity"], STEP, 12).select("entity", "t")


@query(
    _PHASED + """SELECT entity, t, round(1 - avg(ma) OVER f, 9) AS absent, CASE WHEN count(*) OVER f = 4 AND min(ma) OVER f = 1 THEN round(avg(a) OVER f, 6) END AS mean,
  CASE WHEN count(*) OVER f = 4 AND min(ma) OVER f = 1 THEN round(stddev_pop(a) OVER f, 6) END AS std, CASE WHEN count(*) OVER f = 4 AND min(ma) OVER f = 1 THEN min(a) OVER f END AS low,
  CASE WHEN count(*) OVER f = 4 AND min(ma) OVER f = 1 THEN max(a) OVER f END AS high FROM g WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"""
)
def win_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = W.window_statistics(_phased(spark, d), ["entity"], "a", "ma", 4)
    return s.select("entity", "t", F.round("absent", 9).alias("absent"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


@query(
    _PHASED + """SELECT entity, t, len(h)::INT AS n_history, list_sum(h)::BIGINT AS n_observed FROM
  (SELECT entity, t, coalesce(list(ma) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 216000 PRECEDING AND 21600 PRECEDING), []) AS h FROM g)"""
)
def win_history(spark: SparkSession, d: str) -> DataFrame:
    h = _phased(spark, d).select("entity", "t", W.history("ma", ["entity"], "t", 10 * STEP, STEP).alias("h"))
    n = F.when(F.size("h") > 0, F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x))
    return h.select("entity", "t", F.size("h").alias("n_history"), n.alias("n_observed"))


@query(
    f"""WITH {OBS}, {GRID} SELECT g.entity, g.k, coalesce(s.value, 0.0) AS held,
  CASE WHEN g.t >= o.on_t AND (o.off_t IS NULL OR g.t <= o.off_t) THEN coalesce(s.value, 0.0) END AS within FROM grid g
  ASOF LEFT JOIN (SELECT * FROM obs WHERE track = 'purchase') s ON g.entity = s.entity AND g.t >= s.t
  LEFT JOIN (SELECT entity, min(t) FILTER (track = 'view') AS on_t, max(t) FILTER (track = 'click' AND entity % 3 <> 0) AS off_t FROM obs GROUP BY 1) o ON o.entity = g.entity"""
)
def grid_step_hold(spark: SparkSession, d: str) -> DataFrame:
    """A step signal held from its events on, 0 before the first, and null outside its phase."""
    o = _obs(spark, d)
    held = G.ffill_asof(o.where("track = 'purchase'"), _grid(o), ["entity"], None, seq="seq", bucket=7 * 86_400)
    phase = o.groupBy("entity").agg(F.min(F.when(F.col("track") == "view", F.col("t"))).alias("on_t"), F.max(F.when((F.col("track") == "click") & (F.col("entity") % 3 != 0), F.col("t"))).alias("off_t"))
    rows = held.join(phase, "entity", "left").withColumn("held", G.step_hold(F.col("value")))
    return rows.select("entity", "k", "held", G.within_phase(F.col("held"), F.col("t"), F.col("on_t"), F.col("off_t")).alias("within"))
