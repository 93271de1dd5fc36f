"""Relational operators: keyed filters, interval joins, deduplication with defined winners, set operations, table
comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .intervals import covered, intervals_at, last_writer, split_intervals

__all__ = ["covered", "intervals_at", "last_writer", "split_intervals"]


def only_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def exclude_whole_pairs(df: DataFrame, excluded: DataFrame, pairs: DataFrame, key: str, pair: str) -> DataFrame:
    """Without the excluded keys and every key that shares a pair with one."""
    hit = pairs.join(excluded.select(key).distinct(), key, "left_semi").select(pair).distinct()
    gone = pairs.join(hit, pair, "left_semi").select(key).unionByName(excluded.select(key))
    return without_keys(df, gone, [key])


def left_counts(rows: DataFrame, facts: DataFrame, on: list[str], out: str = "n") -> DataFrame:
    return rows.join(facts.groupBy(*on).agg(F.count("*").alias(out)), on, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def islands(df: DataFrame, keys: list[str], order: list[str], on: Column, t: str = "t", x: str | None = None) -> DataFrame:
    """Runs of rows where `on` holds: (keys, island, start, stop, n[, mean of x])."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__on", F.coalesce(on, F.lit(False)))
    edge = (F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False))).cast("int")
    rows = rows.withColumn("island", F.sum(edge).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__on")
    aggs = [F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n")]
    return rows.groupBy(*keys, "island").agg(*aggs, *([F.avg(x).alias("mean")] if x else []))


def actions_to_intervals(actions: DataFrame, keys: list[str], order: list[str], t: str, rate: str) -> DataFrame:
    """Rates set at times to (keys, start, end, rate); the last one is open, zero rates drop out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return actions.select(*keys, F.col(t).alias("start"), F.lead(t).over(w).alias("end"), F.col(rate).alias("rate")).where("rate > 0")


def n_filled(cols: list[str]) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + F.col(c).isNotNull().cast("int")
    return out


def most_complete(df: DataFrame, keys: list[str], cols: list[str], seq: str) -> DataFrame:
    """One row a key: the most non-null values, then the first in source order. An aggregate, so hot keys combine early."""
    rows = df.withColumn("__n", n_filled(cols))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct("__n", -F.col(seq))).alias("__r"))
    return best.select(*keys, "__r.*")


def keep_first(df: DataFrame, keys: list[str], order: list[str], last: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the first by `order` (nulls first), or the last. Of equal rows the first by `ties`, such as file and row, which
    drop out; without them any. Spark leaves out later rows before the shuffle, too, so hot keys combine early."""
    by = [F.desc_nulls_last(c) if last else F.asc_nulls_first(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*by, *ties)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", *ties)


def differing_columns(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, n, differing) of the keys with several rows: names of the columns with more than one value, null counted."""
    several = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int")) > 1
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.filter(F.array(*[F.when(several(c), F.lit(c)) for c in cols]), lambda x: x.isNotNull()).alias("differing"))
    return out.where("n > 1")


def top_abs(df: DataFrame, x: str, tie: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.abs(x).desc_nulls_last(), tie).limit(k)


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], where: Column | None = None, pattern_inf: bool = False) -> DataFrame:
    """(col, n, n_differ, n_pattern, max_abs): null-safe comparison by key, each column as its own type; a key on one side only counts
    as differing. NaN equals NaN. `where` restricts both sides (for prefixes). n_pattern: null on one side only. max_abs is null for
    columns that aren't numbers; with `pattern_inf` it is infinite where a row is null on one side only."""
    if where is not None:
        a, b = a.where(where), b.where(where)
    left = a.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in cols], F.lit(1).alias("__ia"))
    right = b.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in cols], F.lit(1).alias("__ib"))
    both = left.join(right, keys, "full")
    numeric = lambda df, c: isinstance(df.schema[c].dataType, NumericType)

    def cell(c: str) -> Column:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        gap = F.abs(x - y).cast("double") if numeric(a, c) and numeric(b, c) else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("col"), x.eqNullSafe(y).alias("same"), (x.isNull() != y.isNull()).alias("half"), gap.alias("gap"))

    c = both.select(F.explode(F.array(*map(cell, cols))).alias("__c"), "__ia", "__ib").select("__c.*", "__ia", "__ib")
    lone = F.col("__ia").isNull() | F.col("__ib").isNull()
    gap = F.when(~lone & F.col("half"), F.lit(float("inf"))).otherwise(F.col("gap")) if pattern_inf else F.col("gap")
    return c.groupBy("col").agg(
        F.count("*").alias("n"), F.count_if(lone | ~F.col("same")).alias("n_differ"), F.count_if(~lone & F.col("half")).alias("n_pattern"), F.max(gap).alias("max_abs")
    )


def affine_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, slope, intercept, max_residual) of y on x: one pass for the fit and one for the residual."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    r = df.join(F.broadcast(fit))
    return r.groupBy("slope", "intercept").agg(F.count("*").alias("n"), F.max(F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))).alias("max_residual"))


def close(a: Column, b: Column, tol: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tol, a.isNull() & b.isNull())


def value_at(obs: DataFrame, at: DataFrame, keys: list[str], t: str = "at", value: str = "value", seq: str = "seq") -> DataFrame:
    """(keys, at, value): the last finite value at or before a time of each key, of which there is one a key."""
    j = obs.where(F.col(value).isNotNull()).join(at.select(*keys, t), keys).where(F.col("t") <= F.col(t))
    last = j.groupBy(*keys).agg(F.max_by(value, F.struct("t", seq)).alias(value))
    return at.select(*keys, t).join(last, keys, "left")


def changed(x: str, keys: list[str], order: list[str]) -> Column:
    """Whether a value differs from the row before (null-safe); the first row doesn't."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (F.row_number().over(w) > 1) & ~F.col(x).eqNullSafe(F.lag(x).over(w))


def classify(x: Column, rules: list[tuple[str, str, str]], default: str) -> Column:
    """The label of the first rule (how, pattern, label) that fits; how is starts, ends, holds or like (an expression)."""
    out = F.lit(default)
    for how, pattern, label in reversed(rules):
        test = {"starts": x.startswith, "ends": x.endswith, "holds": x.contains, "like": x.rlike}[how](pattern)
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def check_columns(df: DataFrame, allowed: set[str], denied: set[str] = frozenset()) -> DataFrame:
    """`df`, or an error that names the columns that aren't allowed."""
    bad = sorted(c for c in df.columns if c not in allowed or c in denied)
    if bad:
        raise ValueError(f"columns not allowed: {', '.join(bad)}")
    return df
