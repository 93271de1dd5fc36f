"""As-of joins of two irregular series: the sample before, after or nearest to each point.

Points and samples are merged and dealt by (keys, time bucket); within a bucket one window in each direction carries the samples
on. What comes into a bucket from the others is taken from the buckets' summaries, a row a bucket, so no join by range is needed and
a hot entity spreads over its buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("backward", "forward", "nearest")


def asof_join(
    points: DataFrame,
    samples: DataFrame,
    keys: list[str],
    values: list[str],
    direction: str = "nearest",
    tolerance: float | Column | None = None,
    bucket: float = 86_400.0,
    exact: bool = True,
    later: bool = False,
    seq: str | None = None,
) -> DataFrame:
    """The points with the `values` of a sample of their keys, its time (`sample_t`) and its distance (`gap`, not negative); null
    without one. Both sides have a time `t`.

    direction: the last sample at or before the point, the first at or after it, or the nearer of the two; of two as near, the
    earlier one, or the later one if `later`. `exact` says whether a sample at the point's own time counts. Of several samples at one
    time the one with the greatest `seq` is taken. A sample farther than `tolerance` (a number, or a column of the points) is none.
    Samples without a time are left out; points without a time stay, with nulls. bucket: seconds of a time bucket."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    kinds = samples.schema
    value = F.struct(F.col("t").cast("double").alias("t"), *[F.col(v).alias(v) for v in values])
    known = lambda df: df.where(F.col("t").isNotNull() & ~F.isnan(F.col("t").cast("double")))
    s = known(samples).groupBy(*keys, F.col("t").cast("double").alias("__t")).agg(F.max_by(value, F.col(seq) if seq else F.lit(0)).alias("__v"))
    s = s.select(*keys, "__t", F.lit(0).alias("__g"), "__v", F.lit(None).cast(points.schema).alias("__row"))
    p = points.select(*keys, F.col("t").cast("double").alias("__t"), F.lit(1).alias("__g"), F.lit(None).cast(s.schema["__v"].dataType).alias("__v"), F.struct(*points.columns).alias("__row"))
    both = s.unionByName(p).withColumn("__b", F.floor(F.col("__t") / bucket))
    ends = s.withColumn("__b", F.floor(F.col("__t") / bucket)).groupBy(*keys, "__b").agg(F.max_by("__v", "__t").alias("__last"), F.min_by("__v", "__t").alias("__first"))
    # Every bucket that holds points, with what the summaries before and after it carry in.
    spans = both.select(*keys, "__b").distinct().join(ends.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__b": "__kb"}), _same(keys) & (F.col("__b") == F.col("__kb")), "left").drop(*[f"__k_{k}" for k in keys], "__kb")
    up = Window.partitionBy(*keys).orderBy(F.col("__b").asc()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"__before": F.last("__last", ignorenulls=True).over(up), "__after": F.last("__first", ignorenulls=True).over(down)}).drop("__last", "__first")
    side = F.col("__g") if exact else -F.col("__g")  # a sample at the point's time is met before the point, or after it
    part = Window.partitionBy(*keys, "__b")
    back = F.last("__v", ignorenulls=True).over(part.orderBy(F.col("__t").asc(), side).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("__v", ignorenulls=True).over(part.orderBy(F.col("__t").desc(), side).rowsBetween(Window.unboundedPreceding, 0))
    wants = {"__p": back if direction != "forward" else F.lit(None), "__n": ahead if direction != "backward" else F.lit(None)}
    rows = both.withColumns(wants).where("__g = 1")
    rows = rows.join(spans.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__b": "__kb"}), _same(keys) & F.col("__b").eqNullSafe(F.col("__kb")), "left")
    prev, nxt = F.coalesce("__p", "__before"), F.coalesce("__n", "__after")
    if direction == "nearest":
        a, b = F.col("__t") - prev["t"], nxt["t"] - F.col("__t")
        nearer = (b <= a) if later else (b < a)
        pick = F.when(prev.isNull() | F.coalesce(nearer, F.lit(False)), nxt).otherwise(prev)
    else:
        pick = prev if direction == "backward" else nxt
    rows = rows.withColumn("__s", F.when(F.col("__t").isNotNull() & ~F.isnan("__t"), pick)).select("__row.*", F.col("__t").alias("__at"), "__s")
    gap = F.abs(F.col("__at") - F.col("__s.t"))
    near = F.col("__s").isNotNull() if tolerance is None else F.coalesce(gap <= tolerance, F.lit(False))
    got = {v: F.when(near, F.col("__s")[v]).cast(kinds[v].dataType) for v in values}
    return rows.withColumns({**got, "sample_t": F.when(near, F.col("__s.t")), "gap": F.when(near, gap)}).drop("__at", "__s")


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return out
