"""Sequential recurrences over an entity's ordered rows.

Running sums are windows. A first-order recurrence y = a*y + b with constant 0 < a < 1 has a closed form in blocks: within a
block the sum of b[j] * a^(i-j), and the state before the block from the blocks' own recurrence, level by level; all are
windows and equi-joins, so it stays in Catalyst. Systems with several states, those with varying coefficients, and controllers with a
few states are scans of composed maps (`carried`), in which a hot entity spreads over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .carried import Affine, Columns, Finite, scan
from .intervals import intervals_at


def running_dose(df: DataFrame, keys: list[str], order: list[str], bolus: str, rate: str, dt: float, out: str = "dose") -> DataFrame:
    """Cumulative bolus plus rate * dt / 60; the infusion leaves out the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    inf = F.when(F.row_number().over(w) > 1, F.coalesce(F.col(rate), F.lit(0.0)) * (dt / 60)).otherwise(0.0)
    rows = df.withColumn("__inf", inf)
    return rows.withColumn(out, F.sum(F.coalesce(F.col(bolus), F.lit(0.0)) + F.col("__inf")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__inf")


def running_sum(x: str | Column, keys: list[str], order: list[str], strict: bool = False) -> Column:
    """Sum up to the row; with `strict` over the rows strictly before its order values, however close those are: the sum up to
    the row's peers less the peers' own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    if not strict:
        return none(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    upto = F.sum(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return none(upto) - none(F.sum(x).over(Window.partitionBy(*keys, *order)))


def linear_recurrence(df: DataFrame, keys: list[str], order: list[str], a: float, b: Column, out: str = "y", y0: float = 0.0, block: int = 64) -> DataFrame:
    """y[i] = a * y[i-1] + b[i], y before the first row is y0. Blocks bound the powers of a: of `block` rows, fewer for small a, so
    that no power passes 1e250."""
    if not 0 <= a < 1:
        raise ValueError("a must be at least 0 and below 1")
    if a < 1e-250:
        return df.withColumn(out, b)
    block = max(1, min(block, int(250 / max(-np.log10(a), 1e-9))))
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"__i": F.row_number().over(w) - 1, "__b": b})
    rows = rows.withColumns({"__k": F.floor(F.col("__i") / block), "__j": F.col("__i") % block})
    inside = Window.partitionBy(*keys, "__k").orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum(F.col("__b") * F.pow(F.lit(a), -F.col("__j"))).over(inside) * F.pow(F.lit(a), F.col("__j")))
    # The states at the ends of full blocks follow the same recurrence with a ** block, on 1 / block of the rows.
    ends, power = rows.where(F.col("__j") == block - 1).select(*keys, "__k", "__s"), a**block
    if power < 1e-18:
        ends = ends.withColumn("__y", F.col("__s") + F.when(F.col("__k") == 0, F.lit(power * y0)).otherwise(0.0))
    else:
        ends = linear_recurrence(ends.withColumnsRenamed({"__k": "__o", "__s": "__u"}), keys, ["__o"], power, F.col("__u"), "__y", y0, block)
        ends = ends.withColumnRenamed("__o", "__k")
    rows = rows.join(ends.select(*keys, (F.col("__k") + 1).alias("__k"), F.col("__y").alias("__c")), [*keys, "__k"], "left")
    before = F.when(F.col("__k") == 0, F.lit(float(y0))).otherwise(F.col("__c"))
    return rows.withColumn(out, F.col("__s") + F.pow(F.lit(a), F.col("__j") + 1) * before).drop("__i", "__b", "__k", "__j", "__s", "__c")


def ema(df: DataFrame, keys: list[str], order: list[str], x: str, dt: float, tau: float, out: str = "ema") -> DataFrame:
    """Exponential smoothing from rest: y = a*y + (1-a)*x, a = exp(-dt/tau)."""
    a = float(np.exp(-dt / tau))
    return linear_recurrence(df, keys, order, a, F.coalesce(F.col(x), F.lit(0.0)) * (1 - a), out)


def effect_site(df: DataFrame, keys: list[str], order: list[str], rate: str, bolus: str, ke: float, dt: float, out: str = "ce") -> DataFrame:
    """First-order effect: y = a*y + (rate/60)/ke*(1-a), a = exp(-ke*dt); a bolus acts one cell early (the first at 0)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a, z = float(np.exp(-ke * dt)), lambda c: F.coalesce(F.col(c), F.lit(0.0))
    first = F.row_number().over(w) == 1
    rows = df.withColumns({"__n": F.coalesce(F.lead(bolus).over(w), F.lit(0.0)), "__f": F.when(first, z(bolus)).otherwise(0.0), "__r": F.when(first, 0.0).otherwise(z(rate))})
    b = F.col("__r") / 60 / ke * (1 - a) + F.col("__n") + F.col("__f")
    return linear_recurrence(rows, keys, order, a, b, out).drop("__n", "__f", "__r")


def decayed_sum(points: DataFrame, events: DataFrame, keys: list[str], tau: float, dose: str = "dose", out: str = "decayed") -> DataFrame:
    """For each point the sum of dose * exp(-(t - te) / tau) over the events at or before it: a merge of points and events and one
    scan along time, linear in both, instead of a range join."""
    e = events.select(*keys, F.lit(-1).cast("long").alias("id"), F.col("t").cast("double").alias("t"), F.col(dose).cast("double").alias("__d"), F.lit(0).alias("__p"))
    p = points.select(*keys, F.col("id").cast("long").alias("id"), F.col("t").cast("double").alias("t"), F.lit(0.0).alias("__d"), F.lit(1).alias("__p"))

    def step(before: Columns, here: Columns) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(-(here["t"] - before["t"]) / tau)[:, None, None], np.nan_to_num(here["__d"])[:, None]

    kind = Affine(1, step, lambda here: np.nan_to_num(here["__d"])[:, None], ((1.0,),))
    rows = scan(e.unionByName(p), keys, ["t", "__p", "id"], kind, ["t", "__d"], [out])
    return rows.where("__p = 1").select(*keys, "id", "t", out)


def taylor(h: np.ndarray, terms: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(Phi, Psi) of a linear system over one step: sums of h^k/k! and of h^k/(k+1)!."""
    n = len(h)
    phi, psi, power, fact = np.eye(n), np.eye(n), np.eye(n), 1.0
    for k in range(1, terms + 1):
        power = power @ h
        fact *= k
        phi = phi + power / fact
        if k < terms:
            psi = psi + power / (fact * (k + 1))
    return phi, psi


def compartment_matrix(k10: float, k12: float, k13: float, k21: float, k31: float, ke0: float) -> np.ndarray:
    """Three compartments and an effect site, in 1/min."""
    return np.array([[-(k10 + k12 + k13), k21, k31, 0.0], [k12, -k21, 0.0, 0.0], [k13, 0.0, -k31, 0.0], [ke0, 0.0, 0.0, -ke0]])


def transitions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`taylor` of many matrices, n x size x size."""
    eye = np.eye(h.shape[-1])
    h2 = h @ h
    h3 = h2 @ h
    return eye + h + h2 / 2 + h3 / 6 + h2 @ h2 / 24, eye + h / 2 + h2 / 6 + h3 / 24


def linear_system(df: DataFrame, keys: list[str], order: list[str], rate: str, matrix: np.ndarray, volume: float, dt_min: float, out: str = "ce", bolus: str | None = None) -> DataFrame:
    """y <- Phi (y + bolus[i] / volume e1) + Psi (rate[i] / volume * dt) e1 along each entity; `out` is the last state. The first row
    is at rest but for its bolus."""
    phi, psi = taylor(matrix * dt_min)
    drive, size = psi[:, 0] * dt_min / volume, len(matrix)

    def given(here: Columns) -> np.ndarray:
        u = np.zeros((len(here[rate]), size))
        if bolus:
            u[:, 0] = np.nan_to_num(here[bolus]) / volume
        return u

    def step(before: Columns, here: Columns) -> tuple[np.ndarray, np.ndarray]:
        return phi, np.nan_to_num(here[rate])[:, None] * drive + given(here) @ phi.T

    last = tuple(float(i == size - 1) for i in range(size))
    return scan(df, keys, order, Affine(size, step, given, (last,)), [rate, *([bolus] if bolus else [])], [out])


def compartments(df: DataFrame, keys: list[str], order: list[str], rate: str, params: str, dt_min: float, out: str = "ce", bolus: str | None = None) -> DataFrame:
    """`linear_system` with each entity's own parameters (a struct column as `functions.kinetics` makes)."""
    drug = Drug("linear", F.col(rate), F.col(bolus) if bolus else F.lit(0.0), F.col(params))
    return drug_effects(df, keys, order, {"": drug}, dt_min * 60, out).drop("drug")


@dataclass(frozen=True)
class Drug:
    """kind `linear`: three compartments and an effect site with the struct `params`; `exponential`: one compartment with the
    elimination `ke` (1/s), an infusion going to its steady state rate / ke; `rate`: the rate itself. rate is a dose a minute."""

    kind: str
    rate: Column
    bolus: Column
    params: Column | None = None
    ke: float = 1.0


def drug_effects(df: DataFrame, keys: list[str], order: list[str], drugs: dict[str, Drug], dt_s: float, out: str = "ce") -> DataFrame:
    """(keys, drug, order, out) of all drugs in one scan, with the grid's rows dt_s seconds apart. Null rates and boluses are 0. A
    bolus acts at the beginning of its cell, that is on the row before: at once on an exponential effect, and through the
    compartments on a linear one."""
    from ..functions.kinetics import NAMES

    kinds = ("linear", "exponential", "rate")
    none = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    one = []
    for name, g in drugs.items():
        own = [(g.params[n].cast("double") if g.params is not None else F.lit(0.0)).alias(f"__{n}") for n in NAMES]
        one.append(F.struct(F.lit(name).alias("drug"), F.lit(kinds.index(g.kind)).alias("__kind"), F.lit(float(g.ke)).alias("__ke"), none(g.rate).alias("__rate"), none(g.bolus).alias("__bolus"), *own))
    rows = df.select(*dict.fromkeys([*keys, *order]), F.explode(F.array(*one)).alias("__d")).select(*dict.fromkeys([*keys, *order]), "__d.*")
    need, by = ["__kind", "__ke", "__rate", "__bolus", *[f"__{n}" for n in NAMES]], [*keys, "drug"]

    def parts(here: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, p = len(here["__rate"]), {k: here[f"__{k}"] for k in NAMES}
        h = np.zeros((n, 4, 4))
        h[:, 0, 0], h[:, 0, 1], h[:, 0, 2] = -(p["k10"] + p["k12"] + p["k13"]), p["k21"], p["k31"]
        h[:, 1, 0], h[:, 1, 1], h[:, 2, 0], h[:, 2, 2] = p["k12"], -p["k21"], p["k13"], -p["k31"]
        h[:, 3, 0], h[:, 3, 3] = p["ke0"], -p["ke0"]
        phi, psi = transitions(h * (dt_s / 60))
        with np.errstate(divide="ignore", invalid="ignore"):
            b = psi[:, :, 0] * np.where(p["v1"] > 0, here["__rate"] * (dt_s / 60) / p["v1"], 0.0)[:, None]
        a, k = np.exp(-here["__ke"] * dt_s), here["__kind"]
        for code, decay, add in ((1, a, here["__rate"] / 60 / here["__ke"] * (1 - a)), (2, np.zeros(n), here["__rate"])):
            at = k == code
            phi[at], b[at] = 0.0, 0.0
            phi[at, 3, 3], b[at, 3] = decay[at], add[at]
        return phi, b, start(here)

    def start(here: Columns) -> np.ndarray:
        u, k = np.zeros((len(here["__rate"]), 4)), here["__kind"]
        with np.errstate(divide="ignore", invalid="ignore"):
            u[:, 0] = np.where(k == 0, here["__bolus"] / here["__v1"], 0.0)
        u[:, 3] = np.where(k == 1, here["__bolus"], np.where(k == 2, here["__rate"], 0.0))
        return u

    def step(before: Columns, here: Columns) -> tuple[np.ndarray, np.ndarray]:
        phi, b, u = parts(here)
        u[here["__kind"] == 2] = 0.0
        return phi, b + (phi @ u[:, :, None])[:, :, 0]

    rows = _with_next(rows, by, order, "__bolus", "__next") if any(g.kind == "exponential" for g in drugs.values()) else rows.withColumn("__next", F.lit(0.0))
    kind = Affine(4, step, start, ((0.0, 0.0, 0.0, 1.0),))
    done = scan(rows, by, order, kind, need, [out], carry=["__next", "__kind"])
    return done.withColumn(out, F.col(out) + F.when(F.col("__kind") == 1, F.col("__next")).otherwise(0.0)).drop("__next", "__kind")


def _with_next(df: DataFrame, keys: list[str], order: list[str], x: str, out: str) -> DataFrame:
    """The value of x on the entity's next row, 0 on the last: a scan back from the end whose state is the value itself."""
    kind = Affine(1, lambda before, here: (np.zeros((1, 1)), before[x][:, None]), lambda here: np.zeros((len(here[x]), 1)), ((1.0,),))
    rest = [c for c in df.columns if c not in {*keys, *order}]
    return scan(df, keys, order, kind, [x], [out], carry=rest, descending=True)


def infused(grid: DataFrame, infusions: DataFrame, boluses: DataFrame, keys: list[str], matrix: np.ndarray, volume: float, out: str = "ce", span: float = 3600.0) -> DataFrame:
    """Integrates the system over each entity's distinct grid times (seconds) with Runge-Kutta steps as long as their spacing, under
    infusions (start, end, rate a minute; the first to start that holds a time wins, ends closed, null is open) and boluses (t, dose;
    added at the nearest time, the earlier of two). The rates come from the interval index, the boluses from a nearest as-of join, and
    as a step is affine in the state, the integration is a scan. `span`: the infusions' usual length."""
    t = grid.select(*keys, F.col("t").cast("double").alias("t")).distinct()
    rate = intervals_at(t, infusions.select(*keys, "start", "end", F.col("rate").cast("double").alias("rate")), keys, span)
    rate = rate.groupBy(*keys, "t").agg(F.min_by("rate", F.struct("start", "rate")).alias("__rate"))
    dose = asof_join(boluses.select(*keys, F.col("t").cast("double").alias("t"), F.col("dose").cast("double").alias("dose")), t.select(*keys, "t", F.col("t").alias("at")), keys, ["at"])
    dose = dose.where("at is not null").groupBy(*keys, F.col("at").alias("t")).agg(F.sum("dose").alias("__dose"))
    rows, size = t.join(rate, [*keys, "t"], "left").join(dose, [*keys, "t"], "left"), len(matrix)

    def start(here: Columns) -> np.ndarray:
        u = np.zeros((len(here["t"]), size))
        u[:, 0] = np.nan_to_num(here["__dose"]) / volume
        return u

    def step(before: Columns, here: Columns) -> tuple[np.ndarray, np.ndarray]:
        h = np.nan_to_num(here["t"] - before["t"]) / 60
        phi, psi = transitions(h[:, None, None] * matrix[None])
        return phi, psi[:, :, 0] * (h * np.nan_to_num(here["__rate"]) / volume)[:, None] + start(here)

    last = tuple(float(i == size - 1) for i in range(size))
    return scan(rows, keys, ["t"], Affine(size, step, start, (last,)), ["t", "__rate", "__dose"], [out]).select(*keys, "t", out)


def controller(df: DataFrame, keys: list[str], order: list[str], x: str, low: float, high: float, step: float, top: float, hold: int, out: str = "level") -> DataFrame:
    """Start at `step` below `low`, escalate by it while below, up to `top`, stop above `high`; no change within `hold` rows of the
    last. The states are the levels by the rows since the last change, so a row is a table of few states."""
    levels = [0.0]
    while levels[-1] < top:
        levels.append(min(top, levels[-1] + step))
    n, wide = len(levels), hold + 1
    tables = np.zeros((4, n * wide), np.int64)  # for x missing, below, above, between
    for i in range(n):
        for since in range(wide):
            for k in range(4):
                new = i if since < hold or k in (0, 3) else min(n - 1, i + 1) if k == 1 else 0
                tables[k, i * wide + since] = new * wide if new != i else i * wide + min(since + 1, hold)

    def code(here: Columns) -> np.ndarray:
        v = here[x]
        return np.where(np.isnan(v), 0, np.where(v < low, 1, np.where(v > high, 2, 3)))

    kind = Finite(n * wide, lambda before, here: tables[code(here)], lambda here: tables[code(here), hold], tuple(levels[s // wide] for s in range(n * wide)))
    return scan(df, keys, order, kind, [x], [out])


def ar1(df: DataFrame, keys: list[str], order: list[str], phi: float, noise: Column, out: str = "noise") -> DataFrame:
    """An AR(1) process driven by a noise column, which is to be derived from hashes so that reruns agree."""
    return linear_recurrence(df, keys, order, phi, noise, out)
