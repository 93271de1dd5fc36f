"""Resampling of irregular observations to regular grids.

Observations are long: key columns (an entity, often a track), a time `t` in seconds as double, a value. Values that are NaN,
infinite or null count as missing everywhere (`finite`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH_2024 = 1_704_067_200_000_000


def finite(x: Column | str) -> Column:
    """x, or null where it is NaN or infinite."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def wall_micros(ts: str = "ts") -> Column:
    """Microseconds of a timestamp's wall clock, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def observations(events: DataFrame) -> DataFrame:
    """(entity, track, t, value, seq) of the events table; t in seconds since 2024."""
    t = (wall_micros() - F.lit(EPOCH_2024)) / F.lit(1e6)
    return events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("track"), t.alias("t"), finite("value").alias("value"), F.col("event_id").alias("seq"))


def bounds(obs: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, a0, a1): from the grid point at or before the first observation to the last one."""
    return obs.groupBy(*keys).agg((F.floor(F.min("t") / step) * F.lit(float(step))).alias("a0"), F.max("t").alias("a1"))


def make_grid(bounds_: DataFrame, step: float) -> DataFrame:
    """(…, k, t) with t = a0 + k * step over [a0, a1); no row where a1 <= a0. Other columns of the bounds stay."""
    n = F.ceil((F.col("a1") - F.col("a0")) / step).cast("int")
    rows = bounds_.where(F.col("a1") > F.col("a0")).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("t", F.col("a0") + F.col("k") * F.lit(float(step))).drop("a0", "a1")


def ffill_asof(
    samples: DataFrame,
    grid: DataFrame,
    keys: list[str],
    max_age: float | Column | None = None,
    value: str = "value",
    seq: str | None = None,
    bucket: float | None = None,
    out: str = "value",
) -> DataFrame:
    """The grid with the last finite sample at or before each point (`out`), its age (`age`) and presence (`present`, 0 or
    1). A sample older than `max_age` (a number, or a column of the grid) is absent; None holds it for ever. One shuffle on
    the keys: samples and grid are merged and carried on by a window, no range join.

    With `bucket` (seconds) the window runs within time buckets and the last sample before a bucket is carried in from the
    buckets' summaries, so that one entity with most rows spreads over many tasks."""
    own = grid.columns
    numeric = samples.schema[value].dataType.typeName() in ("double", "float")
    s = samples.where((finite(value) if numeric else F.col(value)).isNotNull()).select(
        *keys, F.col("t").alias("__t"), F.lit(0).alias("__g"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("__o"), F.col(value).alias("__v"), F.lit(None).cast(grid.schema).alias("__row")
    )
    g = grid.select(*keys, F.col("t").alias("__t"), F.lit(1).alias("__g"), F.lit(0).cast("long").alias("__o"), F.lit(None).cast(samples.schema[value].dataType).alias("__v"), F.struct(*own).alias("__row"))
    both = s.unionByName(g)
    part = list(keys)
    if bucket:
        both = both.withColumn("__b", F.floor(F.col("__t") / bucket))
        part.append("__b")
    w = Window.partitionBy(*part).orderBy("__t", "__g", "__o").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__g") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))), ignorenulls=True).over(w)
    rows = both.withColumn("__l", last).where("__g = 1")
    if bucket:
        sample = lambda c: F.when(F.col("__g") == 0, c)
        ends = both.groupBy(*part).agg(F.max_by(sample(F.struct(F.col("__t").alias("t"), F.col("__v").alias("v"))), sample(F.struct("__t", "__o"))).alias("__e"))
        before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).drop("__e")
        rows = rows.join(carry, [*keys, "__b"], "left").withColumn("__l", F.coalesce("__l", "__c"))
    rows = rows.select("__row.*", F.col("__l.t").alias("__lt"), F.col("__l.v").alias("__lv"))
    age = F.col("t") - F.col("__lt")
    fresh = F.col("__lt").isNotNull() if max_age is None else F.coalesce(age <= max_age, F.lit(False))
    return rows.withColumns({out: F.when(fresh, F.col("__lv")), "age": F.when(fresh, age), "present": fresh.cast("int")}).drop("__lt", "__lv")


def bin_events(events: DataFrame, grid_bounds: DataFrame, keys: list[str], step: float, value: str = "value", out: str = "total") -> DataFrame:
    """(keys, k, out): sums of the positive finite impulses in the half-open cell (t - step, t] of each grid point. Events
    before the first point count to it; events after the last are dropped."""
    n = F.ceil((F.col("a1") - F.col("a0")) / step)
    k = F.greatest(F.lit(0), F.ceil((F.col("t") - F.col("a0")) / step)).cast("int")
    e = events.where(finite(value) > 0).join(grid_bounds, keys).withColumn("k", k).where(F.col("k") < n)
    return e.groupBy(*keys, "k").agg(F.sum(value).alias(out))


def nearest_cell(t: Column, a0: Column, step: float) -> Column:
    """Number of the nearest grid point; halfway goes to the lower one."""
    return F.ceil((t - a0) / step - 0.5).cast("int")


def trim_edges(grid: DataFrame, keys: list[str], masks: list[str], order: str = "t") -> DataFrame:
    """Without the leading and trailing rows of an entity in which all masks are 0; gaps inside stay. Adds n_head and
    n_tail, the rows trimmed."""
    w = Window.partitionBy(*keys)
    on = F.greatest(*[F.col(m) for m in masks]) if len(masks) > 1 else F.col(masks[0])
    lo, hi = F.min(F.when(on > 0, F.col(order))).over(w), F.max(F.when(on > 0, F.col(order))).over(w)
    rows = grid.withColumns({"__lo": lo, "__hi": hi})
    cut = lambda c: F.sum(c.cast("int")).over(w).cast("long")
    rows = rows.withColumns({"n_head": cut(F.col(order) < F.col("__lo")), "n_tail": cut(F.col(order) > F.col("__hi"))})
    return rows.where(F.col(order).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def coverage(grid: DataFrame, keys: list[str], mask: str = "present") -> DataFrame:
    return grid.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.avg(mask).alias("coverage"))


def sampling_gaps(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, max_gap, median_interval) of the finite samples; the median needs three samples."""
    w = Window.partitionBy(*keys).orderBy("t", "seq")
    d = obs.where(F.col("value").isNotNull()).withColumn("d", F.col("t") - F.lag("t").over(w))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.max("d").alias("max_gap"), F.when(F.count("*") >= 3, F.percentile("d", F.lit(0.5))).alias("median_interval"))


def quantize(x: Column, step: float | Column) -> Column:
    """To multiples of the step, halves to even; null stays null."""
    return F.rint(x / step) * step


def floor_to(t: Column, step: float) -> Column:
    return F.floor(t / step) * F.lit(float(step))


def plausible(x: Column, low: Column | float, high: Column | float) -> Column:
    """1 if present and within the closed range, else 0. The value itself is to be kept either way."""
    return F.coalesce(x.between(low, high), F.lit(False)).cast("int")


def three_state(x: Column, seen_in_cohort: Column, seen_in_case: Column) -> Column:
    """0 observed, 1 absent in the whole cohort, 2 absent in this case or cell."""
    return F.when(~seen_in_cohort, 1).when(~seen_in_case | x.isNull(), 2).otherwise(0)


def masked_zero(x: Column, mask: Column) -> Column:
    """Exactly 0 where the mask says missing."""
    return F.when(mask == 0, x).otherwise(F.lit(0.0))


def phase_label(t: Column, start: Column, end: Column) -> Column:
    """unknown without a start; induction before it; maintenance up to the end (or on, without one); then emergence."""
    return F.when(start.isNull(), "unknown").when(t < start, "induction").when(end.isNull() | (t < end), "maintenance").otherwise("emergence")


def source_cascade(grid: DataFrame, keys: list[str], sources: list[tuple[str, str, str]], least: float = 0.2) -> DataFrame:
    """The first of (name, value column, mask column) whose coverage of the entity reaches `least`: columns chosen, value,
    mask (none, null and 0 if none does)."""
    w = Window.partitionBy(*keys)
    rows = grid.withColumns({f"__c{i}": F.avg(m).over(w) for i, (_, _, m) in enumerate(sources)})
    name, value, mask = F.lit("none"), F.lit(None).cast("double"), F.lit(0)
    for i, (n, v, m) in reversed(list(enumerate(sources))):
        ok = F.col(f"__c{i}") >= least
        name, value, mask = F.when(ok, F.lit(n)).otherwise(name), F.when(ok, F.col(v)).otherwise(value), F.when(ok, F.col(m)).otherwise(mask)
    return rows.withColumns({"chosen": name, "chosen_value": value, "chosen_mask": mask}).drop(*(f"__c{i}" for i in range(len(sources))))


def endpoint_cascade(x0: Column, x1: Column, p0: Column, p1: Column) -> tuple[Column, Column, Column]:
    """(start, end, proxy): a setpoint if both ends have one (proxy 0), else a proxy with both ends (1), else null (2)."""
    a, b = x0.isNotNull() & x1.isNotNull(), p0.isNotNull() & p1.isNotNull()
    pick = lambda s, p: F.when(a, s).when(b, p)
    return pick(x0, p0), pick(x1, p1), F.when(a, 0).when(b, 1).otherwise(2)


def case_bounds(obs: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a0, a1) of cases with marks (keys, case_start, case_end, ane_start, ane_end): from the latest of the first observation
    and the starts to the earliest of the last observation, the second end, and the first end where that is positive. Missing marks
    don't bound. A grid over it starts at a0 and is empty where a1 <= a0."""
    o = obs.groupBy(*keys).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
    j = o.join(marks.select(*keys, "case_start", "case_end", "ane_start", "ane_end"), keys, "left")
    a0 = F.greatest("ane_start", "case_start", "__lo")
    a1 = F.least("ane_end", F.when(F.col("case_end") > 0, F.col("case_end")), "__hi")
    return j.select(*keys, a0.alias("a0"), a1.alias("a1"))


def step_hold(held: Column) -> Column:
    """A held step signal is 0, not null, before its first event."""
    return F.coalesce(held, F.lit(0.0))


def within_phase(x: Column, t: Column, on: Column, off: Column) -> Column:
    """x where t lies in [on, off], else null. A missing `off` is open; without an `on` the phase hasn't been."""
    return F.when(on.isNotNull() & (t >= on) & (off.isNull() | (t <= off)), x)
