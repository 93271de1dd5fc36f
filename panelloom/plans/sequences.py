"""Queries on recurrences and paired branches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import pairs as P
from ..operators import scans as S
from ..operators.asof import asof_join
from .registry import OBS, query, table


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return G.observations(table(spark, d, "events"))


def _r(x, n: int = 6):
    return F.round(x, n)


_ROWS = f"{OBS}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS i, CASE WHEN track = 'purchase' THEN value ELSE 0 END AS bolus, CASE WHEN track = 'view' THEN value ELSE 0 END AS rate FROM obs)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d)
    return o.withColumns({"bolus": F.when(F.col("track") == "purchase", F.col("value")).otherwise(0.0), "rate": F.when(F.col("track") == "view", F.col("value")).otherwise(0.0)})


@query(f"WITH {_ROWS} SELECT seq, round(sum(bolus + CASE WHEN i > 1 THEN rate * (300 / 60) ELSE 0 END) OVER (PARTITION BY entity ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 4) AS dose FROM o")
def scan_running_dose(spark: SparkSession, d: str) -> DataFrame:
    return S.running_dose(_rows(spark, d), ["entity"], ["t", "seq"], "bolus", "rate", 300.0).select("seq", _r("dose", 4).alias("dose"))


@query(
    f"WITH {_ROWS}, c AS (SELECT *, sum(rate) OVER w AS s FROM o WINDOW w AS (PARTITION BY entity ORDER BY t, seq ROWS UNBOUNDED PRECEDING)) "
    "SELECT seq, round(s, 4) AS volume, round(sum(s) OVER (PARTITION BY entity ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 3) AS nested FROM c"
)
def scan_nested_sums(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d).withColumn("s", S.running_sum("rate", ["entity"], ["t", "seq"]))
    return r.withColumn("n", S.running_sum("s", ["entity"], ["t", "seq"])).select("seq", _r("s", 4).alias("volume"), _r("n", 3).alias("nested"))


@query(
    f"WITH {OBS} SELECT seq, round(coalesce(sum(value) OVER (PARTITION BY entity ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0), 4) AS below FROM obs WHERE value IS NOT NULL"
)
def scan_strict_sum(spark: SparkSession, d: str) -> DataFrame:
    """The sum of an entity's smaller values; values lie closer than 1 to each other."""
    o = _obs(spark, d).where("value is not null")
    return o.select("seq", _r(S.running_sum("value", ["entity"], ["value"], strict=True), 4).alias("below"))


_FOLD = """WITH RECURSIVE {rows}, m AS (SELECT entity, seq, i, {b} AS b FROM {src}),
y AS (SELECT entity, seq, i, b AS y FROM m WHERE i = 1 UNION ALL SELECT m.entity, m.seq, m.i, {a!r}::DOUBLE * y.y + m.b FROM y JOIN m ON m.entity = y.entity AND m.i = y.i + 1)
SELECT seq, round(y, 5) AS {out} FROM y"""
_A = math.exp(-60.0 / 300.0)


@query(_FOLD.format(rows=_ROWS, src="o", b=f"value * {1 - _A!r}::DOUBLE", a=_A, out="ema"))
def scan_ema(spark: SparkSession, d: str) -> DataFrame:
    return S.ema(_obs(spark, d), ["entity"], ["t", "seq"], "value", 60.0, 300.0).select("seq", _r("ema", 5).alias("ema"))


_KE, _DT = math.log(2) / 300, 60.0
_E = math.exp(-_KE * _DT)
_CE_ROWS = _ROWS + ", p AS (SELECT *, coalesce(lead(bolus) OVER (PARTITION BY entity ORDER BY i), 0) AS nb FROM o)"


@query(_FOLD.format(rows=_CE_ROWS, src="p", b=f"(CASE WHEN i = 1 THEN 0 ELSE rate END) / 60 / {_KE!r}::DOUBLE * {1 - _E!r}::DOUBLE + nb + CASE WHEN i = 1 THEN bolus ELSE 0 END", a=_E, out="ce"))
def scan_effect_site(spark: SparkSession, d: str) -> DataFrame:
    return S.effect_site(_rows(spark, d), ["entity"], ["t", "seq"], "rate", "bolus", _KE, _DT).select("seq", _r("ce", 5).alias("ce"))


@query(
    f"""WITH {OBS} SELECT p.seq AS id, round(coalesce(sum(e.value * exp(-(p.t - e.t) / 86400)), 0), 6) AS decayed
FROM (SELECT * FROM obs WHERE track = 'view') p LEFT JOIN (SELECT * FROM obs WHERE track = 'purchase') e ON p.entity = e.entity AND e.t <= p.t GROUP BY p.seq"""
)
def scan_decayed_sum(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d)
    e = o.where("track = 'purchase'").select("entity", "t", F.col("value").alias("dose"))
    p = o.where("track = 'view'").select("entity", F.col("seq").alias("id"), "t")
    return S.decayed_sum(p, e, ["entity"], 86_400.0).select("id", _r("decayed").alias("decayed"))


def _rk4(src: str, keep: str, k: dict[str, str], h: str, u: str, c1: str = "c1") -> str:
    """SQL of one Runge-Kutta step of three compartments and an effect site: `keep` and c1 … c4 of the rows of `src`."""
    f = lambda x: [f"-({k['k10']} + {k['k12']} + {k['k13']}) * {x[0]} + {k['k21']} * {x[1]} + {k['k31']} * {x[2]} + {u}", f"{k['k12']} * {x[0]} - {k['k21']} * {x[1]}", f"{k['k13']} * {x[0]} - {k['k31']} * {x[2]}", f"{k['ke0']} * ({x[0]} - {x[3]})"]
    sql = f"SELECT *, {c1} AS x1, c2 AS x2, c3 AS x3, c4 AS x4 FROM {src}"
    at = [f"x{i}" for i in range(1, 5)]
    for n, w in ((1, "0"), (2, f"{h} / 2"), (3, f"{h} / 2"), (4, h)):
        x = at if n == 1 else [f"({a} + {w} * s{n - 1}_{i})" for i, a in enumerate(at, 1)]
        sql = f"SELECT *, {', '.join(f'{e} AS s{n}_{i}' for i, e in enumerate(f(x), 1))} FROM ({sql})"
    return f"SELECT {keep}, {', '.join(f'x{i} + {h} / 6 * (s1_{i} + 2 * s2_{i} + 2 * s3_{i} + s4_{i}) AS c{i}' for i in range(1, 5))} FROM ({sql})"


_M1 = dict(k10="0.119", k12="0.112", k13="0.042", k21="0.055", k31="0.0033", ke0="0.26")


@query(
    f"""WITH RECURSIVE {_ROWS}, m AS (SELECT entity, seq, i, bolus AS b, rate AS r FROM o),
y AS (SELECT entity, seq, i, r / 15.9 AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0.0::DOUBLE AS c4 FROM m WHERE i = 1
  UNION ALL {_rk4("(SELECT m.*, y.c1, y.c2, y.c3, y.c4 FROM y JOIN m ON m.entity = y.entity AND m.i = y.i + 1)", "entity, seq, i", _M1, "(5.0::DOUBLE / 60)", "b / 15.9", "c1 + r / 15.9")})
SELECT entity, seq, round(c4, 6) AS ce FROM y"""
)
def scan_linear_system(spark: SparkSession, d: str) -> DataFrame:
    """Three compartments and an effect site, infused by the purchases, with the views as boluses."""
    m = S.compartment_matrix(*[float(_M1[k]) for k in ("k10", "k12", "k13", "k21", "k31", "ke0")])
    return S.linear_system(_rows(spark, d), ["entity"], ["t", "seq"], "bolus", m, 15.9, 5 / 60, bolus="rate").select("entity", "seq", _r("ce").alias("ce"))


@query(
    f"""WITH RECURSIVE {OBS}, m AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS i FROM obs),
y AS (SELECT entity, seq, i, CASE WHEN value < 10 THEN 0.5 ELSE 0.0 END AS level, CASE WHEN value < 10 THEN 0 ELSE 3 END AS since FROM m WHERE i = 1
  UNION ALL SELECT entity, seq, i, new, CASE WHEN new <> level THEN 0 ELSE since + 1 END FROM (
    SELECT m.entity, m.seq, m.i, y.level, y.since, CASE WHEN y.since + 1 <= 2 OR m.value IS NULL THEN y.level WHEN m.value < 10 THEN least(3.0, y.level + 0.5) WHEN m.value > 40 THEN 0.0 ELSE y.level END AS new
    FROM y JOIN m ON m.entity = y.entity AND m.i = y.i + 1))
SELECT entity, seq, CAST(level AS DOUBLE) AS level FROM y"""
)
def scan_controller(spark: SparkSession, d: str) -> DataFrame:
    return S.controller(_obs(spark, d), ["entity"], ["t", "seq"], "value", 10.0, 40.0, 0.5, 3.0, 2).select("entity", "seq", "level")


@query()
def scan_ar1(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.encode import normal, uniform

    z = normal(uniform("u", F.col("seq")), uniform("v", F.col("seq")))
    return S.ar1(_obs(spark, d), ["entity"], ["t", "seq"], 0.9, z).select("seq", "noise")


# --- pairs: users are pairs; the other branch is a copy that differs from an effect time on, in some pairs -------------

_PAIRS = f"""{OBS},
base AS (SELECT entity AS pair_id, t, value AS x, CASE WHEN seq % 6 = 0 THEN NULL ELSE value * 2 END AS y, seq FROM obs),
meta AS (SELECT pair_id, round(avg(t)) AS split_t, CASE pair_id % 3 WHEN 0 THEN 'drug' WHEN 1 THEN 'vent' ELSE 'none' END AS lever,
  CASE WHEN pair_id % 3 = 0 THEN 't=' || (round(avg(t)) + 7200)::BIGINT || '.5s: change' ELSE 'override' END AS note, max(t) AS t_end FROM base GROUP BY pair_id),
other AS (SELECT b.pair_id, b.t, CASE WHEN lever <> 'none' AND b.t >= split_t + 43200 AND b.t < split_t + 400000 THEN x + b.pair_id % 4 ELSE x END AS x,
  CASE WHEN lever = 'vent' AND b.t >= split_t + 90000 AND y IS NULL THEN 0 ELSE y END AS y FROM base b JOIN meta USING (pair_id) WHERE NOT (b.pair_id % 10 = 4 AND b.seq % 50 = 1)),
j AS (SELECT pair_id, t, split_t, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by", (a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y) AS d FROM base a JOIN other b USING (pair_id, t) JOIN meta USING (pair_id))"""


def _branches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = _obs(spark, d).select(F.col("entity").alias("pair_id"), "t", F.col("value").alias("x"), F.when(F.col("seq") % 6 != 0, F.col("value") * 2).alias("y"), "seq")
    k = F.col("pair_id") % 3
    meta = b.groupBy("pair_id").agg(F.round(F.avg("t")).alias("split_t"), F.max("t").alias("t_end"))
    note = F.when(k == 0, F.concat(F.lit("t="), (F.col("split_t") + 7200).cast("long").cast("string"), F.lit(".5s: change"))).otherwise("override")
    meta = meta.withColumns({"lever": F.when(k == 0, "drug").when(k == 1, "vent").otherwise("none"), "note": note})
    o = b.where(~((F.col("pair_id") % 10 == 4) & (F.col("seq") % 50 == 1))).join(meta, "pair_id")
    x = F.when((F.col("lever") != "none") & (F.col("t") >= F.col("split_t") + 43_200) & (F.col("t") < F.col("split_t") + 400_000), F.col("x") + F.col("pair_id") % 4).otherwise(F.col("x"))
    y = F.when((F.col("lever") == "vent") & (F.col("t") >= F.col("split_t") + 90_000) & F.col("y").isNull(), 0.0).otherwise(F.col("y"))
    return b.drop("seq"), o.select("pair_id", "t", x.alias("x"), y.alias("y")), meta


@query(
    f"""WITH {_PAIRS}, f AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.t, b.t) AS t, a.pair_id IS NOT NULL AS ia, b.pair_id IS NOT NULL AS ib FROM base a FULL JOIN other b ON a.pair_id = b.pair_id AND a.t = b.t)
SELECT pair_id, sum(ia::INT)::BIGINT AS n_base, sum(ib::INT)::BIGINT AS n_other, sum((ia AND t < split_t)::INT)::BIGINT AS n_pre, sum((ia AND t >= split_t)::INT)::BIGINT AS n_post, sum((NOT ia OR NOT ib)::INT) = 0 AND sum(ia::INT) > 0 AS usable
FROM f JOIN meta USING (pair_id) GROUP BY pair_id"""
)
def pair_assembly(spark: SparkSession, d: str) -> DataFrame:
    return P.assemble(*_branches(spark, d))


_DIV = "dv AS (SELECT pair_id, min(t) FILTER (d) AS t_div FROM j GROUP BY pair_id)"


@query(f"WITH {_PAIRS}, {_DIV} SELECT pair_id, t_div, (SELECT CASE WHEN ax IS DISTINCT FROM bx THEN 'x' ELSE 'y' END FROM j WHERE j.pair_id = dv.pair_id AND j.t = t_div) AS col FROM dv")
def pair_first_divergence(spark: SparkSession, d: str) -> DataFrame:
    b, o, _ = _branches(spark, d)
    return P.first_divergence(b, o, ["x", "y"])


@query(f"WITH {_PAIRS} SELECT pair_id, count(*)::BIGINT AS n_prefix, bool_and(NOT d) AS same FROM j WHERE t < split_t GROUP BY pair_id")
def pair_prefix_identity(spark: SparkSession, d: str) -> DataFrame:
    b, o, m = _branches(spark, d)
    return P.prefix_identity(b, o, ["x", "y"], m)


@query(f"WITH {_PAIRS}, k AS (SELECT pair_id, d, row_number() OVER (PARTITION BY pair_id ORDER BY t) - 1 AS k FROM j WHERE t >= split_t) SELECT pair_id, (min(k) FILTER (d))::INT AS lag FROM k GROUP BY pair_id")
def pair_effect_lag(spark: SparkSession, d: str) -> DataFrame:
    b, o, m = _branches(spark, d)
    return P.effect_lag(b, o, ["x", "y"], m)


@query(f"WITH {_PAIRS}, l AS (SELECT pair_id, max(t) FILTER (d) AS last_diff FROM j GROUP BY pair_id) SELECT pair_id, last_diff, min(t) FILTER (t > last_diff) AS rejoined FROM j JOIN l USING (pair_id) GROUP BY pair_id, last_diff")
def pair_reconvergence(spark: SparkSession, d: str) -> DataFrame:
    b, o, _ = _branches(spark, d)
    return P.reconvergence(b, o, ["x", "y"])


_ANN = f"""{_PAIRS}, {_DIV}, an AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(note, '^t=([0-9.]+)s', 1), '') AS DOUBLE), split_t) AS ta FROM meta JOIN dv USING (pair_id))"""


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    b, o, m = _branches(spark, d)
    rows = m.join(P.first_divergence(b, o, ["x", "y"]).drop("col"), "pair_id")
    return rows.withColumn("ta", P.action_time(F.col("note"), F.col("split_t")))


@query(
    f"""WITH {_ANN} SELECT pair_id, ta, CASE WHEN lever <> 'none' THEN least(t_div, floor((ta + 43200) / 300) * 300) END AS t_boundary, t_end <= floor(ta / 300) * 300 - 600 AS all_before, t_end >= floor(ta / 300) * 300 AS some_after,
  CASE WHEN t_div IS NULL THEN 'never' WHEN abs(t_div - ta) <= 50000 THEN 'at_action' WHEN t_div < ta THEN 'before' ELSE 'delayed' END AS delay,
  CASE WHEN t_div IS NOT NULL THEN NULL WHEN t_end <= ta THEN 'case_ends' WHEN lever = 'none' THEN 'no_change_requested' WHEN pair_id % 4 < 0.5 THEN 'below_resolution' WHEN pair_id % 2 = 1 THEN 'clip_bound' ELSE 'unexplained' END AS cause FROM an"""
)
def pair_annotation(spark: SparkSession, d: str) -> DataFrame:
    a = _annotated(spark, d)
    asked = F.when(F.col("lever") != "none", F.col("pair_id") % 4 + 0.25)
    eff = F.when(F.col("lever") != "none", F.col("ta") + 43_200)
    cause = P.null_cause(F.col("t_div").isNotNull(), F.col("t_end"), F.col("ta"), asked, F.lit(0.5), F.col("pair_id") % 2 == 1)
    return a.select(
        "pair_id", "ta", P.boundary(F.col("t_div"), eff, 300.0).alias("t_boundary"), P.before_action(F.col("t_end"), F.col("ta"), 300.0).alias("all_before"), P.after_action(F.col("t_end"), F.col("ta"), 300.0).alias("some_after"),
        P.delay_class(F.col("t_div"), F.col("ta"), 50_000.0).alias("delay"), cause.alias("cause"),
    )


@query(f"WITH {_ANN} SELECT lever, count(*)::BIGINT AS n, sum((t_div IS NOT NULL)::INT)::BIGINT AS n_flag, round(100 * sum((t_div IS NOT NULL)::INT) / count(*), 6) AS percent FROM an GROUP BY lever")
def pair_roll_up(spark: SparkSession, d: str) -> DataFrame:
    a = _annotated(spark, d).withColumn("flag", F.col("t_div").isNotNull())
    return P.roll_up(a, "lever", "flag").withColumn("percent", _r("percent"))


@query(f"WITH {_PAIRS} SELECT pair_id, t, (abs((bx - ax) / 0.5 - round_even((bx - ax) / 0.5, 0)) <= 1e-6 AND round_even((bx - ax) / 0.5, 0) <> 0 AND abs(bx - ax) <= 2) AS \"on\" FROM j")
def pair_delta_on_grid(spark: SparkSession, d: str) -> DataFrame:
    b, o, _ = _branches(spark, d)
    return P.joined(b, o, ["x", "y"]).select("pair_id", "t", P.on_grid(F.col("__b_x") - F.col("x"), 0.5, 2.0).alias("on"))


@query(
    f"""WITH {_PAIRS} SELECT coalesce(a.pair_id, b.pair_id) % 3 <> 2 AS exempt, count(*)::BIGINT AS n, sum((a.pair_id IS NULL OR b.pair_id IS NULL)::INT)::BIGINT AS n_lone,
  sum((a.pair_id IS NOT NULL AND b.pair_id IS NOT NULL AND (a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y))::INT)::BIGINT AS n_differ FROM base a FULL JOIN other b ON a.pair_id = b.pair_id AND a.t = b.t GROUP BY 1"""
)
def pair_identity_gate(spark: SparkSession, d: str) -> DataFrame:
    b, o, _ = _branches(spark, d)
    return P.identity_gate(b, o, ["pair_id", "t"], ["x", "y"], F.col("pair_id") % 3 != 2)


_WHO = "who AS (SELECT c_custkey AS id, 50.0::DOUBLE + c_custkey % 50 AS w, 20.0::DOUBLE + c_custkey % 60 AS age, 150.0::DOUBLE + c_custkey % 45 AS h, c_custkey % 2 = 0 AS male FROM customer)"


@query(
    f"""WITH {_WHO}, x AS (SELECT *, w / pow(h / 100, 2) AS bmi, CASE WHEN male THEN 1.1 * w - 128 * pow(w / h, 2) ELSE 1.07 * w - 148 * pow(w / h, 2) END AS lbm FROM who),
y AS (SELECT *, CASE WHEN male THEN (0.88 * w + 12.8 * pow(h / 100, 2)) / (1 + 0.0273 * bmi) ELSE (1.11 * w + 7.52 * pow(h / 100, 2)) / (1 + 0.0236 * bmi) END / (61.6 + 12.8 * 2.89 / (1 + 0.0273 * (70 / 2.89))) AS size,
  9270 * w / CASE WHEN male THEN 6680 + 216 * bmi ELSE 8780 + 244 * bmi END AS lean FROM x)
SELECT id, round(0.228 * w, 6) AS marsh_v1, round((1.89 + 0.0456 * (w - 77) - 0.0681 * (lbm - 59) + 0.0264 * (h - 177)) / 4.27, 6) AS schnider_k10,
  round(1.79 * pow(size, 0.75) * pow(greatest(age, 18) / 35, -0.446) / (6.28 * size), 6) AS eleveld_k10, round(0.146 * pow(age / 35, -0.25), 6) AS eleveld_ke0, round(5.1 - 0.0201 * (age - 40) + 0.0722 * (lean - 50), 6) AS minto_v1,
  round(0.093 * 0.07 / 0.13, 6) AS wierda_k21 FROM y"""
)
def fn_kinetic_parameters(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import kinetics as K

    k = F.col("c_custkey")
    who = [c.cast("double") for c in (50 + k % 50, 20 + k % 60, 150 + k % 45)]
    w, age, h, male = *who, k % 2 == 0
    return table(spark, d, "customer").select(
        k.alias("id"), _r(K.marsh(w)["v1"]).alias("marsh_v1"), _r(K.schnider(w, age, h, male)["k10"]).alias("schnider_k10"), _r(K.eleveld(w, age, h, male)["k10"]).alias("eleveld_k10"),
        _r(K.eleveld(w, age, h, male)["ke0"]).alias("eleveld_ke0"), _r(K.minto(w, age, h, male)["v1"]).alias("minto_v1"), _r(K.wierda(w)["k21"]).alias("wierda_k21"),
    )


@query(
    """WITH u AS (SELECT event_id, value AS v, value / 3 AS ua, value / 5 AS ub, value / 40 AS ug, value / 10 AS arousal FROM events),
x AS (SELECT *, greatest(ua + ub + ug + 0.05 * ua * ub + 0.05 * ua * ug - arousal * 0.03, -5) AS u FROM u)
SELECT event_id, round(least(greatest(93 - 63 * pow(greatest(u, 0), 1.5) / (1 + pow(greatest(u, 0), 1.5)), 0), 100), 6) AS depth,
  round(least(greatest(200 * 863 / greatest((400 + v - 150) * 12, 500) * pow(1.1, 0.8), 0), 90) * 0.95, 6) AS etco2, round((400 + v) / 50 + 10 * 0.5 + 5, 6) AS pip FROM x"""
)
def fn_response_surfaces(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import kinetics as K

    v, one = F.col("value"), lambda x: F.lit(float(x))
    return table(spark, d, "events").select(
        "event_id", _r(K.depth_index(v, v, v, v / 10, (3.0, 5.0, 40.0), 1.5, 93.0, 30.0)).alias("depth"), _r(K.end_tidal(400 + v, one(150), one(12), one(200), one(1.1))).alias("etco2"),
        _r(K.peak_pressure(400 + v, one(50), one(10), one(0.5), one(5))).alias("pip"),
    )


_PEOPLE = "who AS (SELECT DISTINCT entity, 50.0::DOUBLE + entity % 50 AS w, 20.0::DOUBLE + entity % 60 AS age, 150.0::DOUBLE + entity % 45 AS h, entity % 2 = 0 AS male FROM obs)"
_KS = ("k10", "k12", "k13", "k21", "k31", "ke0")
_BMI = "(w / pow(h / 100, 2))"
_DRUGS_SQL = f"""rows_ AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t, seq) AS i, CASE WHEN track = 'purchase' THEN value ELSE 0 END AS buy, CASE WHEN track = 'view' THEN value ELSE 0 END AS seen,
  CASE WHEN track = 'click' THEN value ELSE 0 END AS hit FROM obs JOIN who USING (entity)),
m0 AS (
  SELECT entity, seq, i, 'a' AS drug, 0 AS kind, seen / 3 AS r, buy AS b, 0.228 * w AS v1, 0.119 AS k10, 0.112 AS k12, 0.0419 AS k13, 0.055 AS k21, 0.0033 AS k31, 0.26 AS ke0, 1.0 AS ke FROM rows_
  UNION ALL SELECT entity, seq, i, 'b', 0, hit, 0, 5.1 - 0.0201 * (age - 40) + 0.0722 * (9270 * w / CASE WHEN male THEN 6680 + 216 * {_BMI} ELSE 8780 + 244 * {_BMI} END - 50), 0.595 - 0.007 * (age - 40), 0.476, 0.212, 0.403 - 0.0026 * (age - 40), 0.029, 0.6, 1.0 FROM rows_
  UNION ALL SELECT entity, seq, i, 'c', 0, 0, buy, 0.07 * w, 0.0037 / 0.07, 0.093, 0.0, 0.093 * 0.07 / 0.13, 0.0, 0.105, 1.0 FROM rows_
  UNION ALL SELECT entity, seq, i, 'd', 1, seen, buy, 1, 0, 0, 0, 0, 0, 0, ln(2) / 300 FROM rows_ UNION ALL SELECT entity, seq, i, 'e', 1, 0, buy, 1, 0, 0, 0, 0, 0, 0, ln(2) / 600 FROM rows_
  UNION ALL SELECT entity, seq, i, 'f', 2, seen, 0, 1, 0, 0, 0, 0, 0, 0, 1 FROM rows_ UNION ALL SELECT entity, seq, i, 'g', 2, hit, buy, 1, 0, 0, 0, 0, 0, 0, 1 FROM rows_),
m AS MATERIALIZED (SELECT entity, seq, i, drug, kind, r::DOUBLE AS r, b::DOUBLE AS b, v1::DOUBLE AS v1, k10::DOUBLE AS k10, k12::DOUBLE AS k12, k13::DOUBLE AS k13, k21::DOUBLE AS k21, k31::DOUBLE AS k31, ke0::DOUBLE AS ke0, ke::DOUBLE AS ke,
  coalesce(lead(b) OVER (PARTITION BY entity, drug ORDER BY i), 0)::DOUBLE AS nb FROM m0)"""


@query(
    f"""WITH RECURSIVE {OBS}, {_PEOPLE}, {_DRUGS_SQL},
y AS (SELECT entity, seq, drug, i, nb, kind, CASE kind WHEN 0 THEN b / v1 ELSE 0 END AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, CASE kind WHEN 1 THEN b WHEN 2 THEN r ELSE 0 END AS c4 FROM m WHERE i = 1
  UNION ALL SELECT entity, seq, drug, i, nb, kind, c1, c2, c3, CASE kind WHEN 0 THEN c4 WHEN 1 THEN (p4 + b) * exp(-ke * 5) + r / 60 / ke * (1 - exp(-ke * 5)) ELSE r END FROM (
  {_rk4("(SELECT m.*, y.c1, y.c2, y.c3, y.c4, y.c4 AS p4 FROM y JOIN m ON m.entity = y.entity AND m.drug = y.drug AND m.i = y.i + 1)", "entity, seq, drug, i, nb, kind, p4, b, r, ke", {k: k for k in _KS}, "(5.0::DOUBLE / 60)", "CASE kind WHEN 0 THEN r / v1 ELSE 0 END", "c1 + CASE kind WHEN 0 THEN b / v1 ELSE 0 END")}))
SELECT entity, seq, drug, round(c4 + CASE kind WHEN 1 THEN nb ELSE 0 END, 5) AS ce FROM y"""
)
def scan_drug_effects(spark: SparkSession, d: str) -> DataFrame:
    """Seven drugs of each entity in one scan: compartments with published parameters, exponential effects, plain rates."""
    from ..functions import kinetics as K

    e = F.col("entity")
    w, age, h, male = (50 + e % 50).cast("double"), (20 + e % 60).cast("double"), (150 + e % 45).cast("double"), e % 2 == 0
    on = lambda track: F.when(F.col("track") == track, F.col("value")).otherwise(0.0)
    none, buy, seen, hit = F.lit(0.0), on("purchase"), on("view"), on("click")
    drugs = {
        "a": S.Drug("linear", seen / 3, buy, K.marsh(w)), "b": S.Drug("linear", hit, none, K.minto(w, age, h, male)), "c": S.Drug("linear", none, buy, K.wierda(w)),
        "d": S.Drug("exponential", seen, buy, ke=math.log(2) / 300), "e": S.Drug("exponential", none, buy, ke=math.log(2) / 600), "f": S.Drug("rate", seen, none), "g": S.Drug("rate", hit, buy),
    }
    return S.drug_effects(_obs(spark, d), ["entity"], ["t", "seq"], drugs, 5.0).select("entity", "seq", "drug", _r("ce", 5).alias("ce"))


@query(
    f"""WITH RECURSIVE {OBS}, {_PEOPLE}, {_DRUGS_SQL},
y AS (SELECT entity, seq, drug, i, b / v1 AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0.0::DOUBLE AS c4 FROM m WHERE i = 1 AND drug = 'a'
  UNION ALL {_rk4("(SELECT m.*, y.c1, y.c2, y.c3, y.c4 FROM y JOIN m ON m.entity = y.entity AND m.drug = y.drug AND m.i = y.i + 1)", "entity, seq, drug, i", {k: k for k in _KS}, "(5.0::DOUBLE / 60)", "r / v1", "c1 + b / v1")})
SELECT entity, seq, round(c4, 5) AS ce FROM y"""
)
def scan_compartments(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with its own published parameters, driven by its rates and boluses."""
    from ..functions import kinetics as K

    rows = _rows(spark, d).withColumns({"p": K.marsh((50 + F.col("entity") % 50).cast("double")), "rate": F.col("rate") / 3})
    return S.compartments(rows, ["entity"], ["t", "seq"], "rate", "p", 5 / 60, bolus="bolus").select("entity", "seq", _r("ce", 5).alias("ce"))


_M2 = dict(k10="0.0119", k12="0.0112", k13="0.0042", k21="0.0055", k31="0.00033", ke0="0.026")


@query(
    f"""WITH RECURSIVE {OBS}, g AS (SELECT DISTINCT entity, t FROM obs WHERE track = 'view'),
rate AS (SELECT g.entity, g.t, min_by(o.value, o.t) AS r FROM g JOIN obs o ON o.entity = g.entity AND o.track = 'click' AND g.t BETWEEN o.t AND o.t + 3600 GROUP BY 1, 2),
near AS (SELECT b.entity, b.value, min_by(g.t, (abs(g.t - b.t), g.t)) AS t FROM obs b JOIN g ON g.entity = b.entity WHERE b.track = 'purchase' GROUP BY b.entity, b.seq, b.value),
dose AS (SELECT entity, t, sum(value) AS b FROM near GROUP BY 1, 2),
m AS (SELECT g.entity, g.t, row_number() OVER w AS i, coalesce(g.t - lag(g.t) OVER w, 0) / 60 AS h, coalesce(r, 0) / 15.9 AS u, coalesce(b, 0) / 15.9 AS b FROM g LEFT JOIN rate USING (entity, t) LEFT JOIN dose USING (entity, t) WINDOW w AS (PARTITION BY g.entity ORDER BY g.t)),
y AS (SELECT entity, t, i, b AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0.0::DOUBLE AS c4 FROM m WHERE i = 1
  UNION ALL SELECT entity, t, i, c1 + b, c2, c3, c4 FROM ({_rk4("(SELECT m.*, y.c1, y.c2, y.c3, y.c4 FROM y JOIN m ON m.entity = y.entity AND m.i = y.i + 1)", "entity, t, i, b", _M2, "h", "u")}))
SELECT entity, t, CASE WHEN abs(c4) < 1e6 THEN round(c4, 4) END AS ce FROM y"""
)
def scan_infused(spark: SparkSession, d: str) -> DataFrame:
    """Views as grid times, clicks as infusions of an hour, purchases as boluses. Steps are as long as the views lie apart, and
    long ones diverge: such values aren't shown."""
    o = _obs(spark, d)
    grid = o.where("track = 'view'").select("entity", "t")
    inf = o.where("track = 'click'").select("entity", F.col("t").alias("start"), (F.col("t") + 3600).alias("end"), F.col("value").alias("rate"))
    bol = o.where("track = 'purchase'").select("entity", "t", F.col("value").alias("dose"))
    got = S.infused(grid, inf, bol, ["entity"], S.compartment_matrix(*[float(_M2[k]) for k in _KS]), 15.9)
    return got.select("entity", "t", F.when(F.abs("ce") < 1e6, _r("ce", 4)).alias("ce"))


_SERIES = f"{OBS}, p AS (SELECT seq, entity, t FROM obs WHERE track = 'view'), s AS (SELECT entity, t, max(seq) AS sid FROM obs WHERE track = 'purchase' GROUP BY 1, 2)"


@query(
    f"""WITH {_SERIES}, b AS (SELECT p.*, s.sid AS bid, s.t AS bt FROM p ASOF LEFT JOIN s ON p.entity = s.entity AND p.t >= s.t), f AS (SELECT p.seq, s.sid AS fid, s.t AS ft FROM p ASOF LEFT JOIN s ON p.entity = s.entity AND p.t <= s.t),
n AS (SELECT seq, CASE WHEN bt IS NULL OR ft - t < t - bt THEN fid ELSE bid END AS sid, CASE WHEN bt IS NULL OR ft - t < t - bt THEN ft - t ELSE t - bt END AS gap FROM b JOIN f USING (seq))
SELECT seq, CASE WHEN gap <= 43200 THEN sid END AS sid, CASE WHEN gap <= 43200 THEN round(gap * 1e6)::BIGINT END AS gap_us FROM n"""
)
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The purchase nearest in time to each view, at most half a day away: two irregular series."""
    p, s = _series(spark, d)
    return asof_join(p, s, ["entity"], ["sid"], "nearest", 43_200.0, seq="sid").select("seq", "sid", F.round(F.col("gap") * 1e6).cast("long").alias("gap_us"))


@query(f"WITH {_SERIES} SELECT p.seq, s.sid, round((s.t - p.t) * 1e6)::BIGINT AS gap_us FROM p ASOF LEFT JOIN s ON p.entity = s.entity AND p.t < s.t")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    """The first purchase strictly after each view."""
    p, s = _series(spark, d)
    return asof_join(p, s, ["entity"], ["sid"], "forward", exact=False, seq="sid").select("seq", "sid", F.round(F.col("gap") * 1e6).cast("long").alias("gap_us"))


def _series(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = _obs(spark, d)
    return o.where("track = 'view'").select("seq", "entity", "t"), o.where("track = 'purchase'").select("entity", "t", F.col("seq").alias("sid"))


@query(f"WITH {_PAIRS}, {_DIV}, an AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(note, '^t=([0-9.]+)s', 1), '') AS DOUBLE), split_t) AS ta FROM meta) SELECT pair_id, coalesce(bool_or(d) FILTER (t > ta), false) AS differs FROM j JOIN an USING (pair_id) GROUP BY pair_id")
def pair_differs_after(spark: SparkSession, d: str) -> DataFrame:
    b, o, m = _branches(spark, d)
    return P.differs_after(b, o, ["x", "y"], m.withColumn("ta", P.action_time(F.col("note"), F.col("split_t"))))


@query(f"WITH {_PAIRS} SELECT a.pair_id, a.t, coalesce(abs(round_even(a.x / 5, 0) * 5 - b.x) <= 2.5 + 1e-9, false) AS same FROM base a JOIN other b USING (pair_id, t)")
def pair_recorded_vs_applied(spark: SparkSession, d: str) -> DataFrame:
    b, o, _ = _branches(spark, d)
    j = b.select("pair_id", "t", "x").join(o.select("pair_id", "t", F.col("x").alias("z")), ["pair_id", "t"])
    return j.select("pair_id", "t", P.recorded_vs_applied(G.quantize(F.col("x"), 5.0), F.col("z"), 5.0).alias("same"))
