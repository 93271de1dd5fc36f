"""Readers and writers: projected scans, schema inventories, partitioned sinks, resuming, manifests, hashes, caches.

Everything goes through Spark's own sources, so paths may be in any store that Spark opens."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir), or in a new one where none is set. What is
    written there is deleted when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("panelloom.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        base = "file://" + tempfile.mkdtemp(prefix="panelloom-")
        spark.conf.set("panelloom.scratch.dir", base)
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(root)
    store.deleteOnExit(root)
    return f"{root.toString()}/data"


def select_existing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns with their types; those that the table lacks are null. Only existing ones reach the scan."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def read_projected(spark: SparkSession, path: str | list[str], columns: dict[str, str], merge: bool = False) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return select_existing(spark.read.option("mergeSchema", str(merge).lower()).parquet(*paths), columns)


def schema_inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(source, column, type) from footers only."""
    rows = [(s, f.name, f.dataType.simpleString()) for s, p in paths.items() for f in spark.read.parquet(p).schema.fields]
    return spark.createDataFrame(rows, "source string, column string, type string")


def partition_counts(df: DataFrame, parts: list[str]) -> DataFrame:
    """Rows a partition; over partition columns this needs no data page."""
    return df.groupBy(*parts).agg(F.count("*").alias("n"))


def union_relaxed(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to unite")
    return out


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_documents(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON documents of any layout; a given schema saves a pass for inference."""
    r = spark.read.option("multiLine", "true")
    return (r.schema(schema) if schema else r).json(path)


def write_partitioned(df: DataFrame, path: str, parts: list[str], entity: str, order: list[str], max_records: int = 200_000, mode: str = "overwrite") -> None:
    """zstd Parquet by partition columns. Rows are dealt by (parts, entity), so an entity's rows of a partition come from
    one task and in order, and a hot partition spreads over its entities."""
    dealt = df.repartition(*parts, entity).sortWithinPartitions(*parts, entity, *order)
    dealt.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", max_records).partitionBy(*parts).parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> DataFrame:
    """The rows as a table bucketed and sorted by `keys`, under a name of its own: tables with the same keys and number of buckets are
    joined and grouped by them without a shuffle. Rows are dealt by bucket first, so that a bucket is one file."""
    name = f"panelloom_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't processed yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def table_hash(df: DataFrame) -> DataFrame:
    """(n, digest): a hash of the rows that doesn't depend on their order."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("digest"))


def row_sha256(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def folder_sha256(path: str | Path) -> str:
    top, h = Path(path), hashlib.sha256()
    for p in sorted(x for x in top.rglob("*") if x.is_file()):
        h.update(f"{p.relative_to(top)} {file_sha256(p)}\n".encode())
    return h.hexdigest()


def manifest(df: DataFrame, parts: list[str], parameters: dict) -> dict:
    """Provenance of a table: parameters, counts a partition, hash. Small by the number of partitions."""
    counts = {"/".join(str(r[p]) for p in parts): r["n"] for r in partition_counts(df, parts).collect()}
    total = table_hash(df).first()
    return {"parameters": parameters, "columns": dict(df.dtypes), "rows": total["n"], "digest": total["digest"], "partitions": dict(sorted(counts.items()))}


def write_json(spark: SparkSession, doc: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cached(spark: SparkSession, folder: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made for `key` (parameters, code version): read if it is there, else made and written."""
    path = f"{folder.rstrip('/')}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:24]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_case_tables(tables: dict[str, DataFrame], path: str, entity: str = "entity") -> None:
    """Several artifacts of the same cases (tracks, truth, attributes, notes) under one folder."""
    for name, df in tables.items():
        df.repartition(entity).write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{name}")


@dataclass(frozen=True)
class PanelConfig:
    """Parameters of a panel build. `to_yaml` writes one "name: value" line a field, which `from_yaml` reads."""

    step_s: float = 5.0
    window_cells: int = 12
    default_age_s: float = 30.0
    coverage_floor: float = 0.2
    train_percent: int = 85
    rare_below: int = 50
    seed: str = "0"

    def to_yaml(self) -> str:
        return "".join(f"{k}: {json.dumps(v)}\n" for k, v in asdict(self).items())

    @classmethod
    def from_yaml(cls, text: str) -> PanelConfig:
        known, got = {f.name for f in fields(cls)}, {}
        for line in text.splitlines():
            name, sep, value = line.partition("#")[0].partition(":")
            if sep:
                if name.strip() not in known:
                    raise KeyError(name.strip())
                try:
                    got[name.strip()] = json.loads(value)
                except ValueError:
                    got[name.strip()] = value.strip().strip("'")
        return cls(**got)


def report(df: DataFrame, title: str, width: int = 14) -> str:
    """A fixed-width text of a small table (at most a few hundred rows)."""
    cell = lambda v: (f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v))[: width - 1].ljust(width)
    lines = [title, "".join(map(cell, df.columns)).rstrip()]
    return "\n".join(lines + ["".join(cell(v) for v in r).rstrip() for r in df.collect()]) + "\n"
