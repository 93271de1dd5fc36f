"""Paired branches: a base and an intervened copy of an entity that part at a time.

Branch rows are (pair_id, t, values…); pair metadata is one row a pair: pair_id, split_t, lever, action text, end times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import time_in_text
from .grid import floor_to


def action_time(note: Column, split_t: Column) -> Column:
    """The time in the action's text, else the split."""
    return F.coalesce(time_in_text(note), split_t)


def boundary(t_div: Column, t_eff: Column, step: float) -> Column:
    """The earlier of the first difference and the effect's cell; null without an effect."""
    return F.when(t_eff.isNotNull(), F.least(t_div, floor_to(t_eff, step)))


def before_action(t1: Column, ta: Column, step: float) -> Column:
    return t1 <= floor_to(ta, step) - 2 * step


def after_action(t1: Column, ta: Column, step: float) -> Column:
    return t1 >= floor_to(ta, step)


def assemble(base: DataFrame, other: DataFrame, meta: DataFrame) -> DataFrame:
    """(pair_id, n_base, n_other, n_pre, n_post, usable): counts of windows, and whether both branches have the same t0s.
    One full join; set equality is a count of lone rows."""
    j = base.select("pair_id", "t", F.lit(1).alias("a")).join(other.select("pair_id", "t", F.lit(1).alias("b")), ["pair_id", "t"], "full").join(meta.select("pair_id", "split_t"), "pair_id")
    n = lambda c: F.count_if(c)
    out = j.groupBy("pair_id").agg(
        F.count("a").alias("n_base"), F.count("b").alias("n_other"), n(F.col("a").isNotNull() & (F.col("t") < F.col("split_t"))).alias("n_pre"),
        n(F.col("a").isNotNull() & (F.col("t") >= F.col("split_t"))).alias("n_post"), n(F.col("a").isNull() | F.col("b").isNull()).alias("__lone"),
    )
    return out.withColumn("usable", (F.col("__lone") == 0) & (F.col("n_base") > 0)).drop("__lone")


def joined(base: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of both branches by (pair_id, t), with __d: any of the columns differs (null-safe)."""
    b = other.select("pair_id", "t", *[F.col(c).alias(f"__b_{c}") for c in cols])
    d = F.lit(False)
    for c in cols:
        d = d | ~F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return base.select("pair_id", "t", *cols).join(b, ["pair_id", "t"]).withColumn("__d", d)


def first_divergence(base: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """(pair_id, t_div, col): the first difference, and the first of the columns that shows it."""
    j = joined(base, other, cols)
    name = F.coalesce(*[F.when(~F.col(c).eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in cols])
    return j.groupBy("pair_id").agg(F.min(F.when(F.col("__d"), F.col("t"))).alias("t_div"), F.min_by(F.when(F.col("__d"), name), F.when(F.col("__d"), F.col("t"))).alias("col"))


def prefix_identity(base: DataFrame, other: DataFrame, cols: list[str], meta: DataFrame) -> DataFrame:
    """(pair_id, n_prefix, same): whether all columns agree strictly before the split."""
    j = joined(base, other, cols).join(meta.select("pair_id", "split_t"), "pair_id").where("t < split_t")
    return j.groupBy("pair_id").agg(F.count("*").alias("n_prefix"), F.bool_and(~F.col("__d")).alias("same"))


def effect_lag(base: DataFrame, other: DataFrame, cols: list[str], meta: DataFrame) -> DataFrame:
    """(pair_id, lag): how many rows after the split the first difference is; null if there is none."""
    j = joined(base, other, cols).join(meta.select("pair_id", "split_t"), "pair_id").where("t >= split_t")
    k = F.row_number().over(Window.partitionBy("pair_id").orderBy("t")) - 1
    return j.withColumn("k", k).groupBy("pair_id").agg(F.min(F.when(F.col("__d"), F.col("k"))).alias("lag"))


def reconvergence(base: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """(pair_id, last_diff, rejoined): the last difference and the next time both have (null: none follows)."""
    j = joined(base, other, cols)
    last = j.groupBy("pair_id").agg(F.max(F.when(F.col("__d"), F.col("t"))).alias("last_diff"))
    return j.join(last, "pair_id").groupBy("pair_id", "last_diff").agg(F.min(F.when(F.col("t") > F.col("last_diff"), F.col("t"))).alias("rejoined"))


def null_cause(changed: Column, case_end: Column, t_action: Column, requested: Column, resolution: Column, bound: Column) -> Column:
    """Why a pair shows no effect; the first rule that fits."""
    return (
        F.when(changed, None).when(case_end <= t_action, "case_ends").when(requested.isNull() | (requested == 0), "no_change_requested")
        .when(F.abs(requested) < resolution, "below_resolution").when(bound, "clip_bound").otherwise("unexplained")
    )


def delay_class(t_div: Column, t_action: Column, near: float = 30.0) -> Column:
    return F.when(t_div.isNull(), "never").when(F.abs(t_div - t_action) <= near, "at_action").when(t_div < t_action, "before").otherwise("delayed")


def on_grid(delta: Column, step: float, most: float, tol: float = 1e-6) -> Column:
    """Whether a difference is a non-zero whole number of steps within a bound."""
    k = delta / step
    return (F.abs(k - F.rint(k)) <= tol) & (F.rint(k) != 0) & (F.abs(delta) <= most)


def roll_up(pairs: DataFrame, group: str, flag: str) -> DataFrame:
    return pairs.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_flag"), (100 * F.count_if(F.col(flag)) / F.count("*")).alias("percent"))


def identity_gate(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], exempt: Column) -> DataFrame:
    """(exempt, n, n_lone, n_differ): rows of two generations by class; the gate passes where the class that isn't exempt
    has no lone and no differing row."""
    left = a.select(*keys, *cols, exempt.alias("__x"), F.lit(1).alias("__ia"))
    right = b.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in cols], exempt.alias("__y"), F.lit(1).alias("__ib"))
    d = F.lit(False)
    for c in cols:
        d = d | ~F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    lone = F.col("__ia").isNull() | F.col("__ib").isNull()
    j = left.join(right, keys, "full")
    return j.groupBy(F.coalesce("__x", "__y").alias("exempt")).agg(F.count("*").alias("n"), F.count_if(lone).alias("n_lone"), F.count_if(~lone & d).alias("n_differ"))


def differs_after(base: DataFrame, other: DataFrame, cols: list[str], meta: DataFrame, ta: str = "ta") -> DataFrame:
    """(pair_id, differs): whether any column differs strictly after the action's time."""
    j = joined(base, other, cols).join(meta.select("pair_id", ta), "pair_id")
    return j.groupBy("pair_id").agg(F.coalesce(F.bool_or(F.when(F.col("t") > F.col(ta), F.col("__d"))), F.lit(False)).alias("differs"))


def recorded_vs_applied(recorded: Column, applied: Column, step: float) -> Column:
    """Whether a quantised record stands for the applied value: within half a step."""
    return F.coalesce(F.abs(recorded - applied) <= step / 2 + 1e-9, F.lit(False))
