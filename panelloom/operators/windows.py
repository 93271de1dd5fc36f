"""Sliding windows over regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worst_state(mask: Column, w) -> Column:
    """1 if any 1, else 2 if any 2, else 0."""
    return F.when(F.max((mask == 1).cast("int")).over(w) == 1, 1).when(F.max((mask == 2).cast("int")).over(w) == 1, 2).otherwise(0)


def transition_windows(
    grid: DataFrame,
    keys: list[str],
    step: int,
    cells: int,
    ends: list[str] = (),
    maxima: list[str] = (),
    sums: list[str] = (),
    masks: list[str] = (),
    phase: str | None = None,
    wanted: str = "maintenance",
) -> DataFrame:
    """One row for each cell t0 whose following `cells` cells all exist: keys, t0, t1, <c>_t0 and <c>_t1 of `ends`, <c>_max
    and <c>_sum over the cells after t0, <c>_worst of three-state masks. With `phase`, both ends must have the wanted one.
    The frame is a range of times, so holes need no second path. t is a long."""
    key = Window.partitionBy(*keys).orderBy("t")
    w = key.rangeBetween(step, step * cells)
    at_end = lambda c: F.last(c).over(w)  # noqa: E731  the frame ends at t1 if all cells are there
    cols = {"__n": F.count("*").over(w), "t1": F.col("t") + F.lit(step * cells)}
    cols |= {f"{c}_t1": at_end(c) for c in ends} | {f"{c}_max": F.max(c).over(w) for c in maxima} | {f"{c}_sum": F.sum(c).over(w) for c in sums}
    cols |= {f"{c}_worst": worst_state(F.col(c), w) for c in masks}
    if phase:
        cols["__p1"] = at_end(phase)
    rows = grid.withColumns(cols).where(F.col("__n") == cells)
    if phase:
        rows = rows.where((F.col(phase) == wanted) & (F.col("__p1") == wanted))
    return rows.select(
        *keys, F.col("t").alias("t0"), "t1", *(x for c in ends for x in (F.col(c).alias(f"{c}_t0"), F.col(f"{c}_t1"))),
        *(f"{c}_max" for c in maxima), *(f"{c}_sum" for c in sums), *(f"{c}_worst" for c in masks),
    )


def anchor_stride(windows: DataFrame, keys: list[str], stride: int, t: str = "t0") -> DataFrame:
    """The windows at the first t0 of an entity and every `stride` after it."""
    anchor = F.min(t).over(Window.partitionBy(*keys))
    return windows.withColumn("__a", anchor).where((F.col(t) - F.col("__a")) % stride == 0).drop("__a")


def discard_counts(grid: DataFrame, keys: list[str], step: int, cells: int, phase: str, wanted: str = "maintenance") -> DataFrame:
    """How many candidate windows fall out for a hole, an earlier phase or a later one, and how many remain."""
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(step, step * cells)
    rows = grid.withColumns({"__n": F.count("*").over(w), "__p1": F.last(phase).over(w)})
    hole = F.col("__n") < cells
    early = ~hole & (F.col(phase) != wanted)
    late = ~hole & (F.col(phase) == wanted) & (F.col("__p1") != wanted)
    ok = ~hole & (F.col(phase) == wanted) & (F.col("__p1") == wanted)
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in (("n_hole", hole), ("n_start", early), ("n_end", late), ("n_valid", ok))))


def moving_average(x: str, keys: list[str], order: str, width: int) -> Column:
    """Trailing mean of up to `width` rows."""
    return F.avg(x).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - width, 0))


def run_starts(grid: DataFrame, keys: list[str], step: int, cells: int) -> DataFrame:
    """The rows from which `cells` rows follow each other without a hole."""
    w = Window.partitionBy(*keys).orderBy("t")
    return grid.withColumn("__e", F.lead("t", cells - 1).over(w)).where(F.col("__e") - F.col("t") == step * (cells - 1)).drop("__e")


def window_statistics(grid: DataFrame, keys: list[str], x: str, mask: str, cells: int) -> DataFrame:
    """Over each row and the `cells` - 1 after it: share absent, and mean, population deviation, minimum and maximum if all
    are there and observed (mask 1)."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, cells - 1)
    full = (F.count("*").over(w) == cells) & (F.min(mask).over(w) == 1)
    cols = {"absent": 1 - F.avg(mask).over(w)}
    cols |= {n: F.when(full, f(x).over(w)) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))}
    return grid.withColumns(cols)


def history(x: str, keys: list[str], t: str, back: int, until: int) -> Column:
    """Values at times t - back … t - until, oldest first."""
    return F.collect_list(x).over(Window.partitionBy(*keys).orderBy(t).rangeBetween(-back, -until))
