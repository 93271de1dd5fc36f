"""Global order: a row's position among all rows, without a sort in one task.

Rows are dealt by ranges of (order, hash of the row), so that equal values and nulls are split, too, sorted within their task and
written; a row's place in its task and the counts of the tasks before it give its position. The driver sees one count a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch

#: Rows of a task, about.
ROWS = 1_000_000
#: Bits of monotonically_increasing_id below the task's number.
_BITS = 33


def _tie(df: DataFrame) -> Column:
    return F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes])


def sorted_runs(df: DataFrame, order: list[str | Column], rows_per_task: int | None = None, tie: bool = True) -> DataFrame:
    """The rows, dealt by ranges of `order` and sorted within each task; rows that are equal in `order` by a hash of the whole row
    (any order, if not `tie`)."""
    by = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order] + ([_tie(df)] if tie else [])
    tasks = max(1, -(-df.count() // (rows_per_task or ROWS)))
    return (df.repartitionByRange(tasks, *by) if tasks > 1 else df.coalesce(1)).sortWithinPartitions(*by)


def positions(df: DataFrame, order: list[str | Column], out: str = "position", rows_per_task: int | None = None) -> DataFrame:
    """`df` with each row's position, from 0, in the order of the columns (nulls first) or sort expressions; equal rows in the order
    of a hash of the whole row. An order over equal rows that matter has to name the columns that tell them apart."""
    path = scratch(df.sparkSession, "positions")
    sorted_runs(df, order, rows_per_task).withColumn("__pos_m", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.parquet(path)
    part = F.shiftright("__pos_m", _BITS)
    at, begin = 0, []
    for p, n in sorted((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):  # a row a task
        begin.append((p, at))
        at += n
    begin = df.sparkSession.createDataFrame(begin, "__pos_p long, __pos_at long")
    rows = held.join(F.broadcast(begin), part == F.col("__pos_p"))
    return rows.withColumn(out, F.col("__pos_at") + F.col("__pos_m").bitwiseAND((1 << _BITS) - 1)).drop("__pos_m", "__pos_p", "__pos_at")


def write_sorted(df: DataFrame, path: str, order: list[str | Column], rows_per_task: int | None = None) -> None:
    """A table in total order: the files' names follow the ranges, and each file is sorted, so readers prune by footers."""
    sorted_runs(df, order, rows_per_task).write.mode("overwrite").option("compression", "zstd").parquet(path)


def sample_positions(df: DataFrame, order: list[str | Column], n: int, seed: str = "0", out: str = "position") -> DataFrame:
    """n rows of all, each position as likely as any other: those with the smallest hashes of seed and position."""
    rows = positions(df, order, out)
    return rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(out).cast("string")), 256)).orderBy("__h").limit(n).drop("__h")
