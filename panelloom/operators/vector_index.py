"""Exact nearest neighbours by a metric index.

Pivots are a bounded sample of the vectors. A vector belongs to the cell of its nearest pivot and keeps its distance r to it; a cell is
dealt in chunks of about `CHUNK` rows. By the triangle inequality a vector of the cell is at least |d(q, pivot) - r| away from a query
q, and the cell at least max(d - r_max, r_min - d, (d - d_nearest) / 2).

1. A query searches the cells nearest to it until they hold k rows: its kth distance there bounds the true one.
2. It then goes only to those other cells that the bound doesn't exclude, and in them to the rows that it doesn't exclude.

So the result is that of comparing everything, ties by id included, whatever the sample. A task holds one chunk and the queries that
come to it, and keeps k rows a query. The driver holds the pivots and a row a cell."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.io import scratch

CHUNK = 20_000
PIVOTS = 256
_OUT, _IN = 1 - 1e-9, 1 + 1e-9


@dataclass
class Index:
    rows: DataFrame  # id, v, cell, r, chunk
    pivots: np.ndarray
    cells: pd.DataFrame  # cell, n, lo, hi, chunks
    id_col: str


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to one vector b."""
    return np.sqrt(((a - b) ** 2).sum(1))


def build(base: DataFrame, vec: str, id_col: str, pivots: int | None = None, chunk: int = CHUNK) -> Index:
    """The index of all vectors that aren't null; they have one length. pivots: about the root of the number of rows by default,
    `PIVOTS` at most."""
    spark = base.sparkSession
    rows = base.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    m = pivots or min(PIVOTS, max(1, round(rows.count() ** 0.5)))
    drawn = rows.select("v", F.xxhash64("id", F.lit("pivots")).alias("h")).orderBy("h").limit(m).collect()  # m rows
    points = np.array([r["v"] for r in drawn], dtype=float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            d = np.stack([_far(v, p) for p in points], axis=1)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(v)), cell])], names=["id", "v", "cell", "r"])

    schema = StructType([StructField("id", base.schema[id_col].dataType), *StructType.fromDDL("v array<double>, cell int, r double").fields])
    path = scratch(spark, "vector-index")
    (rows.mapInArrow(place, schema) if len(points) else spark.createDataFrame([], schema)).write.parquet(path)
    placed = spark.read.schema(schema).parquet(path)
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).toPandas()  # m rows
    cells["chunks"] = -(-cells["n"] // chunk)
    counts = spark.createDataFrame([(int(c), int(k)) for c, k in zip(cells["cell"], cells["chunks"], strict=True)], "cell int, chunks int")
    placed = placed.join(F.broadcast(counts), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    return Index(placed, points, cells, id_col)


def _asked(queries: DataFrame, index: Index, k: int, bound: str | None) -> DataFrame:
    """(query, q, cell, chunk, d, bound): the cells that each query goes to: first those nearest that hold k + 1 rows, then, with a
    bound, the others that it doesn't exclude."""
    cells, pivots = index.cells.sort_values("cell"), index.pivots
    at, n, lo, hi, chunks = (cells[c].to_numpy() for c in ("cell", "n", "lo", "hi", "chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, limit = _matrix(b.column("q")), b.column("bound").to_numpy(zero_copy_only=False)
            row, cell, part, far = [], [], [], []
            for i, x in enumerate(q):
                d = _far(pivots[at], x)
                near = np.argsort(d, kind="stable")
                first = int(np.searchsorted(np.cumsum(n[near]), k + 1)) + 1
                go = near[:first]
                if bound:
                    rest = near[first:]
                    least = np.maximum(np.maximum(d[rest] - hi[rest] * _IN, lo[rest] * _OUT - d[rest]), (d[rest] - d.min()) / 2) * _OUT
                    go = rest[least <= limit[i] * _IN] if limit[i] == limit[i] else rest
                for c in go:
                    for j in range(chunks[c]):
                        row.append(i)
                        cell.append(at[c])
                        part.append(j)
                        far.append(d[c])
            took = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("query").take(took), b.column("q").take(took), pa.array(cell, pa.int32()), pa.array(part, pa.int32()), pa.array(far, pa.float64()), b.column("bound").take(took)], names=["query", "q", "cell", "chunk", "d", "bound"])

    rows = queries.select("query", "q", (F.col(bound) if bound else F.lit(None)).cast("double").alias("bound"))
    schema = StructType([StructField("query", queries.schema["query"].dataType), *StructType.fromDDL("q array<double>, cell int, chunk int, d double, bound double").fields])
    return rows.mapInArrow(run, schema)


def _searched(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """(query, id, distance, seen): of each query the k nearest rows of each chunk it goes to; seen: the rows it was compared with."""

    def run(base: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        who_, ids_, far_, seen = [], [], [], []
        if len(base) and len(some):
            base = base.sort_values("id")
            v, r, ids = np.stack(base["v"].to_numpy()).astype(float), base["r"].to_numpy(), base["id"].to_numpy()
            for who, q, d, most in zip(some["query"], some["q"], some["d"], some["bound"], strict=True):
                open_ = most != most
                near = np.flatnonzero(ids != who) if open_ else np.flatnonzero((np.abs(r - d) <= most * _IN + d * 1e-9) & (ids != who))
                far = _far(v[near], np.asarray(q, dtype=float))
                best = np.argsort(far, kind="stable")[:k]
                best = best if open_ else best[far[best] <= most * _IN]
                who_ += [who] * (len(best) + 1)
                ids_ += [*ids[near[best]].tolist(), None]  # a row about the query itself comes last
                far_ += [*far[best].tolist(), None]
                seen += [0] * len(best) + [len(near)]
        return pd.DataFrame({"query": who_, "id": pd.Series(ids_, dtype="object"), "distance": pd.Series(far_, dtype="float64"), "seen": seen})

    kind = index.rows.schema["id"].dataType
    schema = StructType([StructField("query", asked.schema["query"].dataType), StructField("id", kind), *StructType.fromDDL("distance double, seen long").fields])
    return index.rows.groupBy("cell", "chunk").cogroup(asked.groupBy("cell", "chunk")).applyInPandas(run, schema)


def search(index: Index, queries: DataFrame, vec: str, id_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """((query, id, rank, distance) of the k nearest rows of each query, rows of the query's own id left out, ties by id; (query, seen):
    the rows that each was compared with)."""
    spark = queries.sparkSession
    q = queries.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("query"), F.col(vec).cast("array<double>").alias("q"))

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    first = keep(_searched(_asked(q, index, k, None), index, k), "first")
    w = Window.partitionBy("query").orderBy("distance", "id")  # k rows a chunk
    top = first.where("id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    bounds = top.groupBy("query").agg(F.when(F.count("*") >= k, F.max("distance")).alias("far"))  # fewer than k rows: no bound
    second = keep(_searched(_asked(q.join(bounds, "query", "left"), index, k, "far"), index, k), "second")
    both = first.unionByName(second)
    best = both.where("id is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query", "id", "rank", "distance"), both.groupBy("query").agg(F.sum("seen").alias("seen"))
