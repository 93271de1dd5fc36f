"""Points in intervals by hierarchical bins.

An interval (keys, start, end, …) belongs to one level: the narrowest of the widths span, 4 span, 16 span, … that isn't shorter than
it. It touches two bins of that width at most, so it makes two rows whatever its length. A point looks up the one bin that holds it
on each level that occurs; at most 64 levels do, as widths beyond 4**61 spans count as open. The join is an equi-join on (keys,
level, bin), which adaptive execution splits where a key is hot. A bin of a level is at most about eight times as wide as its
intervals, so what the join brings together is near what it keeps.

An end that is null, NaN or infinite is open: the interval holds from its start for ever. A start that is null, NaN or minus infinity
holds from ever. Such intervals are on a level of their own with one bin. Points without a time are in no interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 4
TOP = 61
OPEN = -1


def _bound(c: str | Column) -> Column:
    """The time, or null where it is open."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def width_of(level: Column, span: float) -> Column:
    return F.pow(F.lit(float(FANOUT)), level) * F.lit(float(span))


def levelled(intervals: DataFrame, span: float) -> DataFrame:
    """The intervals that don't end before they start, with __s and __e, null where open, and their __level."""
    start, end = _bound("start"), _bound("end")
    iv = intervals.withColumns({"__s": start, "__e": end}).where(F.col("__s").isNull() | F.col("__e").isNull() | (F.col("__e") >= F.col("__s")))
    length = (F.col("__e") - F.col("__s")) / F.lit(float(span))
    level = F.when(length <= 1, 0).otherwise(F.ceil(F.log(length) / F.log(F.lit(float(FANOUT)))))
    level = F.when(length.isNull() | (level > TOP), OPEN).otherwise(level).cast("int")
    return iv.withColumn("__level", level)


def binned(intervals: DataFrame, span: float) -> DataFrame:
    """`levelled` with __bin, a row for each bin that an interval touches (two at most)."""
    iv = levelled(intervals, span)
    at = lambda c: F.floor(F.col(c) / width_of(F.col("__level"), span))
    bins = F.when(F.col("__level") == OPEN, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(at("__s"), at("__e")))
    return iv.withColumn("__bin", F.explode(bins))


def intervals_at(points: DataFrame, intervals: DataFrame, keys: list[str], span: float, t: str = "t", closed: bool = True) -> DataFrame:
    """Points joined with the intervals of their keys that hold them: start <= t <= end, or t < end if not `closed`. `span` is the
    least width of a bin: about the length of the shortest common intervals."""
    iv = binned(intervals, span)
    levels = levelled(intervals, span).agg(F.collect_set("__level").alias("__levels"))  # one row of TOP + 2 numbers at most
    at = F.when(F.col("__level") == OPEN, F.lit(0).cast("long")).otherwise(F.floor(F.col(t) / width_of(F.col("__level"), span)))
    looks = points.crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).drop("__levels").withColumn("__bin", at)
    inside = (F.col("__s").isNull() | (F.col(t) >= F.col("__s"))) & (F.col("__e").isNull() | ((F.col(t) <= F.col("__e")) if closed else (F.col(t) < F.col("__e"))))
    known = F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
    return looks.join(iv, [*keys, "__level", "__bin"]).where(inside & known).drop("__level", "__bin", "__s", "__e")


def last_writer(points: DataFrame, intervals: DataFrame, keys: list[str], row: str, value: str, seq: str, baseline: Column, span: float, last: bool = True, closed: bool = True) -> DataFrame:
    """(row, value): of the intervals over a point the one written last (or first), else the baseline."""
    hit = intervals_at(points, intervals, keys, span, closed=closed)
    pick = F.max_by if last else F.min_by
    best = hit.groupBy(row).agg(pick(F.struct(F.col(value).alias("v")), F.col(seq)).alias("__v"))
    return points.withColumn("__base", baseline).join(best, row, "left").select(row, F.when(F.col("__v").isNotNull(), F.col("__v.v")).otherwise(F.col("__base")).alias(value))


def split_intervals(intervals: DataFrame, cuts: DataFrame, keys: list[str], span: float = 3600.0) -> DataFrame:
    """(keys, id, start, end): each interval cut at the points strictly within it; open ends stay open."""
    c = cuts.select(*keys, F.col("cut").alias("p"))
    j = intervals_at(c, intervals.select(*keys, "id", "start", "end"), keys, span, "p")
    c = j.where((F.col("start").isNull() | (F.col("p") > F.col("start"))) & (F.col("end").isNull() | (F.col("p") < F.col("end")))).select(*keys, "id", "p", "end")
    p = intervals.select(*keys, "id", F.col("start").alias("p"), "end").unionByName(c).distinct()
    w = Window.partitionBy(*keys, "id").orderBy(F.col("p").asc_nulls_first())
    return p.select(*keys, "id", F.col("p").alias("start"), F.coalesce(F.lead("p").over(w), F.col("end")).alias("end"))


def covered(points: DataFrame, intervals: DataFrame, keys: list[str], row: str, span: float, out: str = "covered", closed: bool = True) -> DataFrame:
    """The points with 1 where any interval of their keys holds them, else 0."""
    hit = intervals_at(points.select(*keys, "t", row), intervals.select(*keys, "start", "end"), keys, span, closed=closed).select(row).distinct()
    return points.join(hit.withColumn(out, F.lit(1)), row, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))
