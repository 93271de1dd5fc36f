"""Mergeable aggregates over panels: all are partial on the map side and final after one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import cumulated, quantiles, row_numbers

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name: str = "col", value: str = "value") -> DataFrame:
    """Long form of numeric columns; one pass, no union of scans."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])).alias("__x")).select(*keys, "__x.*")


def mean_std(x: Column | str) -> tuple[Column, Column]:
    """Mean and population deviation; a deviation of zero, or none, is 1."""
    return F.avg(x), F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0))


def masked_mean(x: Column, mask: Column) -> Column:
    return F.coalesce(F.avg(F.when(mask == 1, x)), F.lit(0.0))


def marginals(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Count, mean, deviation and the seven quantiles (linear interpolation) of each group."""
    names = [f"__g_{k}" for k in keys]
    q = quantiles(df, x, list(QUANTILES), keys, "__q").withColumnsRenamed(dict(zip(keys, names, strict=True)))
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    on = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, names, strict=True)]
    out = out.join(q, on or F.lit(True), "left")
    return out.select(*keys, "n", "mean", "std", *(F.col("__q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(QUANTILES)))


def quantization(df: DataFrame, entity: list[str], group: list[str], order: list[str], x: str) -> DataFrame:
    """n, distinct values, share of integers, least non-zero increment within an entity, share unchanged."""
    w = Window.partitionBy(*entity).orderBy(*order)
    d = df.withColumn("__d", F.when(F.col(x).isNotNull(), F.abs(F.col(x) - F.lag(x).over(w))))
    return d.groupBy(*group).agg(
        F.count(x).alias("n"),
        F.countDistinct(x).alias("n_distinct"),
        F.avg((F.abs(F.col(x) - F.rint(x)) <= 1e-6).cast("int")).alias("frac_int"),
        F.min(F.when(F.col("__d") > 1e-9, F.col("__d"))).alias("min_increment"),
        F.avg((F.col("__d") == 0).cast("int")).alias("frac_unchanged"),
    )


def column_audit(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, col, n, n_null, constant, all_zero) of each numeric column."""
    u = unpivot(df, keys, cols)
    return u.groupBy(*keys, "col").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.coalesce(F.min("value") == F.max("value"), F.lit(False)).alias("constant"),
        F.coalesce((F.min("value") == 0) & (F.max("value") == 0), F.lit(False)).alias("all_zero"),
    )


def macro_average(df: DataFrame, entity: list[str], group: list[str], x: Column) -> DataFrame:
    """Mean over entities of their means."""
    per = df.groupBy(*group, *entity).agg(F.avg(x).alias("__m"))
    return per.groupBy(*group).agg(F.count("__m").alias("n_entities"), F.avg("__m").alias("macro"))


def persistence_error(df: DataFrame, keys: list[str], order: list[str], x: str, horizons: tuple[int, ...] = (1, 12, 60), group: list[str] | None = None) -> DataFrame:
    """(group, horizon, n, mae): mean absolute error of taking x for its value `horizon` rows later in the same entity; rows where one
    of the two is missing don't count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*(group or []), *[F.abs(F.lead(x, h).over(w) - F.col(x)).alias(f"__h{h}") for h in horizons])
    return unpivot(rows, group or [], [f"__h{h}" for h in horizons]).groupBy(*(group or []), F.substring("col", 4, 10).cast("int").alias("horizon")).agg(F.count("value").alias("n"), F.avg("value").alias("mae"))


def prevalence(df: DataFrame, entity: str, group: str) -> DataFrame:
    """Share of all entities that have the group at all."""
    pairs = df.select(entity, group).distinct()
    total = df.select(entity).distinct().agg(F.count("*").alias("__n"))
    return pairs.groupBy(group).agg(F.count("*").alias("n_entities")).join(F.broadcast(total)).select(group, "n_entities", (F.col("n_entities") / F.col("__n")).alias("prevalence"))


def coverage_table(facts: DataFrame, rows: DataFrame, cols: DataFrame, row: str, col: str) -> DataFrame:
    """Counts for every pair of two small dimensions (a row each), zeros included."""
    n = facts.groupBy(row, col).agg(F.count("*").alias("n"))
    return rows.crossJoin(cols).join(n, [row, col], "left").select(row, col, F.coalesce("n", F.lit(0)).alias("n"))


def checksums(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n, total, squares) of each numeric column in one pass."""
    u = unpivot(df, [], cols)
    return u.groupBy("col").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rare_to_other(df: DataFrame, col: str, least: int, other: str = "other") -> DataFrame:
    """`df` with the values of `col` that fewer than `least` rows have replaced."""
    common = df.groupBy(col).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(F.col(col).alias("__c"))
    return df.join(common, F.col(col) == F.col("__c"), "left").withColumn(col, F.coalesce("__c", F.lit(other))).drop("__c")


def edges_below(x: Column, edges: str, most: int) -> Column:
    """How many of an array's first `most` edges are at or below x, as a sum of comparisons that is compiled."""
    out = F.lit(0)
    for i in range(most):
        out = out + F.when(F.get(edges, F.lit(i)) <= x, 1).otherwise(0)
    return out


def bin_means(df: DataFrame, x: str, y: str, n_bins: int = 10, least: int = 10) -> DataFrame:
    """Mean of y by percentile bins of x (distinct edges, half-open, so the maximum falls out), bins of `least` rows or
    more. The edges are one aggregate, `n_bins` + 1 numbers."""
    edges = quantiles(df, x, [i / n_bins for i in range(n_bins + 1)], []).select(F.array_distinct("q").alias("__e"))
    rows = df.join(F.broadcast(edges))
    b = edges_below(F.col(x), "__e", n_bins + 1) - 1
    rows = rows.withColumn("bin", b).where(F.col("bin").between(0, F.size("__e") - 2))
    centre = (F.get("__e", F.col("bin")) + F.get("__e", F.col("bin") + 1)) / 2
    out = rows.groupBy("bin", centre.alias("centre")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))
    return out.where(F.col("n") >= least)


def interpolate(curve: DataFrame, at: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """`at` with `y` of the piecewise linear curve, ends clamped. Points are numbered, and each place gets the number of the points
    up to it; the two points around it come by equi-joins."""
    points = row_numbers(curve.select(F.col(x).cast("double").alias("px"), F.col(y).alias("py")), "px", [], out="i")
    last = points.agg(F.max("i").alias("last"))
    both = points.select(F.col("px").alias("x"), F.lit(True).alias("p")).unionByName(at.select(F.col(x).cast("double").alias("x"), F.lit(False).alias("p")))
    upto = cumulated(both, "x", F.col("p"), []).where("b > 0").select("x", "b", F.col("ca").alias("i")).join(F.broadcast(last))
    lo = points.select(F.col("i").alias("il"), F.col("px").alias("xl"), F.col("py").alias("yl"))
    hi = points.select(F.col("i").alias("ih"), F.col("px").alias("xh"), F.col("py").alias("yh"))
    rows = upto.join(lo, F.greatest("i", F.lit(1)) == F.col("il")).join(hi, F.least(F.col("i") + 1, F.col("last")) == F.col("ih"))
    inside = F.col("xh") > F.col("xl")
    value = F.col("yl") + F.when(inside & (F.col("i") > 0), (F.col("x") - F.col("xl")) * (F.col("yh") - F.col("yl")) / (F.col("xh") - F.col("xl"))).otherwise(0.0)
    rows = rows.withColumn("v", value)
    found = rows.select(F.col("x").alias("__x"), F.col("v").alias(y))
    return at.select(x).join(found, F.col(x).cast("double") == F.col("__x"), "left").select(x, y)


def fit_normalization(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """(col, mean, std) on the training rows; small, to be broadcast."""
    m, s = mean_std("value")
    return unpivot(df.where(train), [], cols).groupBy("col").agg(m.alias("mean"), s.alias("std"))


def normalize(df: DataFrame, stats: DataFrame, cols: list[str], masks: dict[str, str] | None = None, logs: tuple[str, ...] = ()) -> DataFrame:
    """z-scores in place; log1p first for `logs`; exactly 0 where the column's mask isn't 0 or the value is missing."""
    held = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("mean", "std")))).alias("__s"))  # a row a column
    rows = df.join(F.broadcast(held))
    new = {}
    for c in cols:
        x = F.log1p(c) if c in logs else F.col(c)
        z = (x - F.col("__s")[c]["mean"]) / F.col("__s")[c]["std"]
        z = F.coalesce(z, F.lit(0.0))
        new[c] = F.when(F.col(masks[c]) == 0, z).otherwise(F.lit(0.0)) if masks and c in masks else z
    return rows.withColumns(new).drop("__s")


def denormalize(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean
