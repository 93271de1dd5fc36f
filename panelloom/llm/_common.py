"""Shared plumbing: table access, the shared scratch folder, and the training split of the digest queries."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and a Python worker; whole rows, so one longer text passes it.
BATCH_BYTES = 8 << 20


#: What a Python worker keeps between tasks: by the name of the step that uses it.
CACHES: dict[str, dict] = {"pieces": {}, "tokens": {}, "chat": {}}


def _trim() -> None:
    """Gives freed memory back, so that a worker's size is what it uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _drop_caches(keeps: str | None) -> None:
    for name, held in CACHES.items():
        if name != keeps:
            held.clear()


def arrow(df: DataFrame, run: Callable, schema, keeps: str | None = None) -> DataFrame:
    """mapInArrow with batches of bounded size, which bound the memory of the Python workers. A task first drops what earlier
    steps left in its worker, but for the cache that it `keeps` using."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def trimming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            _trim()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_caches(keeps)
        yield from run(trimming(batches))
        _trim()

    return df.mapInArrow(bounded, schema)


class Scratch:
    """Tables written to the shared folder to cut lineage. Each holds the rows of one step, so that a lost executor
    costs a re-read and never a recomputation of the whole chain."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch(spark, name), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that isn't read again. Spark deletes the shuffles of plans that are gone when the driver collects garbage."""
        path = getattr(df, "_scratch_path", None)
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def sweep(self) -> None:
        """Collects the driver's garbage, and with it the shuffles of plans that are gone, and gives freed memory back."""
        gc.collect()
        _trim()
        self.spark._jvm.System.gc()


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3, is 1. Null ids are not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_fraction(counts: dict, bound: int) -> dict:
    """Per class, the share of rows to draw so that about `bound` remain."""
    return {k: min(1.0, bound / n) for k, n in counts.items() if n}


def hash_unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) from the columns' hash; stable over runs and partitionings."""
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_003)) / F.lit(1_000_003.0)
