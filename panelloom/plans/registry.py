"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; `sql` is what DuckDB runs on the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The events as observations, and a grid of 6 h by user.
OBS = "obs AS (SELECT user_id AS entity, event_type AS track, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value, event_id AS seq FROM events)"
GRID = """bnd AS (SELECT entity, floor(min(t) / 21600) * 21600.0 AS a0, max(t) AS a1 FROM obs GROUP BY entity),
grid AS (SELECT entity, k::INT AS k, a0 + k * 21600.0 AS t FROM bnd, LATERAL (SELECT unnest(range(0, ceil((a1 - a0) / 21600)::BIGINT)) AS k) WHERE a1 > a0)"""
