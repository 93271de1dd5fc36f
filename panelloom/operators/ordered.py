"""Exact order statistics without a whole group in one task.

Quantiles of at most `DIRECT` rows are one aggregate, which holds a group's distinct values. Beyond, and for running counts, a column's distinct values with their counts are written once. Up to `SMALL` of them are ordered by one window a group. More are dealt
by ranges of (group, value) in buckets of about `SMALL` rows; each bucket is ordered for itself, and the buckets' counts are then
carried over a row a bucket. Row numbers come from global positions (`positions`), which split equal values and nulls. Nulls take no
part in the statistics; null group keys are a group like any other. NaN and infinite values count as missing, as everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import scratch
from .grid import finite
from .positions import positions

SMALL = 500_000
DIRECT = 1_000_000


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """a joined with b, whose columns `cols` are equal (null with null); b's are left out."""
    b = b.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
    return a.join(b, on).drop(*[f"__r_{c}" for c in cols])


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cumulated(df: DataFrame, x: str, side: Column, group: list[str]) -> DataFrame:
    """Distinct values with counts (a, b), running sums with the value (ca, cb), totals (na, nb) and the next value."""
    real = dict(df.dtypes)[x] in ("double", "float")
    n = df.where((finite(x) if real else F.col(x)).isNotNull()).groupBy(*group, F.col(x).alias("x")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    n = _written(n, "values")
    one, size = [F.col(c) for c in group] or [F.lit(0)], n.count()  # from the footers
    if size <= SMALL:
        order, whole = Window.partitionBy(*one).orderBy("x"), Window.partitionBy(*one)
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        return n.select(
            *group, "x", "a", "b", F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"), F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"), F.lead("x").over(order).alias("next")
        )
    by = [*[F.col(c).asc_nulls_first() for c in group], F.col("x").asc()]
    n = _written(n.repartitionByRange(-(-size // SMALL), *by).withColumn("__k", F.spark_partition_id()), "buckets")
    k = n.groupBy(*group, "__k").agg(F.sum("a").alias("ka"), F.sum("b").alias("kb"), F.min("x").alias("kx"))
    order = Window.partitionBy(*one).orderBy("__k")  # a row a bucket
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*one)
    none = lambda c: F.coalesce(c, F.lit(0))
    k = k.select(
        *group, "__k", none(F.sum("ka").over(before)).alias("pa"), none(F.sum("kb").over(before)).alias("pb"), F.sum("ka").over(whole).alias("na"), F.sum("kb").over(whole).alias("nb"),
        F.lead("kx").over(order).alias("nx"),
    )
    inside = Window.partitionBy(*group, "__k").orderBy("x")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumns({"ia": F.sum("a").over(upto), "ib": F.sum("b").over(upto), "next": F.lead("x").over(inside)})
    n = _same(n, k, [*group, "__k"])
    return n.select(*group, "x", "a", "b", (F.col("pa") + F.col("ia")).alias("ca"), (F.col("pb") + F.col("ib")).alias("cb"), "na", "nb", F.coalesce("next", "nx").alias("next"))


def quantiles(df: DataFrame, x: str, ps: list[float], group: list[str], out: str = "q") -> DataFrame:
    """(group, out): an array of the exact quantiles of x, linear between neighbours; groups without a value have no row."""
    rows = df.select(*group, F.col(x).cast("double").alias("__x"))
    if rows.count() <= DIRECT:
        none = F.array(*[F.lit(None).cast("double") for _ in ps])
        v = rows.withColumn("__x", finite("__x")).where("__x is not null")
        return v.groupBy(*group).agg(F.coalesce(F.percentile("__x", F.array(*[F.lit(float(p)) for p in ps])), none).alias(out))
    c = cumulated(rows, "__x", F.lit(True), group)
    cols = []
    for p in ps:
        at = (F.col("na") - 1) * F.lit(float(p))
        for name, k in (("l", F.floor(at)), ("h", F.ceil(at))):
            cols.append(F.min(F.when(F.col("ca") > k, F.col("x"))).alias(f"__{name}{len(cols) // 2}"))
    found = c.groupBy(*group).agg(F.max("na").alias("__rn_n"), *cols)
    value = lambda i, p: F.col(f"__l{i}") + ((F.col("__rn_n") - 1) * p - F.floor((F.col("__rn_n") - 1) * p)) * (F.col(f"__h{i}") - F.col(f"__l{i}"))
    return found.select(*group, F.array(*[value(i, F.lit(float(p))) for i, p in enumerate(ps)]).alias(out))


def quantiles_of(df: DataFrame, cols: list[tuple[str, str]], ps: list[float]) -> DataFrame:
    """One row with an array of exact quantiles of each column (column and name of the array); few rows are read once for all."""
    if df.count() <= DIRECT:
        return df.agg(*[F.percentile(finite(F.col(c).cast("double")), F.array(*[F.lit(float(p)) for p in ps])).alias(out) for c, out in cols])
    return reduce(lambda a, b: a.join(F.broadcast(b)), [quantiles(df, c, ps, [], out) for c, out in cols])


def row_numbers(df: DataFrame, x: str, group: list[str], tie: list[str | Column] | None = None, out: str = "rank", count: str | None = None) -> DataFrame:
    """`df` with the row number by x (then `tie`, then a hash of the row) within each group, and with the group's `count`. Rows with a
    null x come first. A group's rows lie together in the global order, so a row's number is its position less the group's first."""
    rows = positions(df, [*group, x, *(tie or [])], "__rn_pos")
    firsts = rows.groupBy(*group).agg(F.min("__rn_pos").alias("__rn_first"), F.count("*").alias("__rn_n"))
    rows = _same(rows, firsts, group) if group else rows.join(F.broadcast(firsts))
    rows = rows.withColumn(out, F.col("__rn_pos") - F.col("__rn_first") + 1)
    rows = rows.withColumn(count, F.col("__rn_n")) if count else rows
    return rows.drop("__rn_pos", "__rn_first", "__rn_n")
