"""Streaming forms: event-time windows, sessions, deduplication, stateful as-of. Each takes a streaming or a batch frame
with a timestamp column.

Files of a source may come in any order. Windows and sessions without a watermark are complete tables: drained in complete mode no row
is ever late. The stateful as-of keeps what it needs to correct itself (`asof_previous`). Append mode takes a `watermark`; then a row
that is older than it, when it comes, is dropped, as Spark defines it, so it has to cover the disorder of the source."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from ..sources.io import scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files under a path, with the schema they have now."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    pattern = f"{folder}/[{name[0]}]{name[1:]}" if name else path  # a pattern, so that a single file counts, too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def _marked(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, watermark) if df.isStreaming and watermark else df


def window_counts(df: DataFrame, keys: list[str], width: str, slide: str | None = None, ts: str = "ts", value: str = "value", watermark: str | None = None) -> DataFrame:
    """(keys, start, n, total) of tumbling or sliding windows. Append mode needs a watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = _marked(df, ts, watermark).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(*keys, F.col("w.start").alias("start"), "n", "total")


def session_counts(df: DataFrame, keys: list[str], gap: str, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """(keys, start, end, n) of sessions that a silence of `gap` ends. Append mode needs a watermark; with one, rows older than it are
    dropped in complete mode, too."""
    g = _marked(df, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(df: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "2 days") -> DataFrame:
    df = _marked(df, ts, watermark)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


class _AsOf(StatefulProcessor):
    """State of a key, in time order: the samples of the wanted track, and the rows whose answer a later sample may still change."""

    def __init__(self, wanted: str, max_age_s: float, lateness_s: float | None, columns: tuple[str, str, str, str], id_kind: str):
        self.wanted, self.columns, self.id_kind = wanted, columns, id_kind
        self.max_age, self.lateness = max_age_s * 1e6, None if lateness_s is None else lateness_s * 1e6  # times are microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", f"t double, id {self.id_kind}, v double")
        self.asked = handle.getListState("asked", f"t double, id {self.id_kind}, version long")
        self.newest = handle.getValueState("newest", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        ts, track, value, id_col = self.columns
        newest = self.newest.get()[0] if self.newest.exists() else float("-inf")
        samples = sorted(tuple(r) for r in self.samples.get())
        asked = sorted((r[0], r[1], r[2]) for r in self.asked.get())
        horizon = newest - self.lateness if self.lateness is not None else float("-inf")
        fresh, out = [], []
        for pdf in rows:
            times = pdf[ts].astype("datetime64[us]").astype("int64").to_numpy()
            for t, i, kind, v in zip(times, pdf[id_col], pdf[track], pdf[value], strict=True):
                new = [float(t), int(i), kind == self.wanted and v == v and v is not None, float(v) if v is not None else float("nan")]
                fresh.append(new)
        samples = sorted(samples + [(t, i, v) for t, i, hit, v in fresh if hit])
        at = [s[0] for s in samples]

        def held(t: float) -> float | None:
            """Of the last sample strictly before t, if it isn't too old."""
            k = bisect_left(at, t) - 1
            return samples[k][2] if k >= 0 and t - at[k] <= self.max_age else None

        news = sorted(t for t, _, hit, _ in fresh if hit)

        def touched(t: float) -> bool:
            """Whether a new sample lies within the age before t."""
            return bisect_left(news, t) > bisect_left(news, t - self.max_age)

        still = []
        for t, i, version in asked:
            if touched(t):
                version += 1
                out.append((i, held(t), version, False))
            still.append((t, i, version))
        for t, i, _, _ in fresh:
            out.append((i, held(t), 0, t < horizon))
            still.append((t, i, 0))
        newest = max([newest, *(t for t, _, _, _ in fresh)])
        if self.lateness is not None:
            # Rows older than the horizon are final, and samples that only they could use are dropped.
            horizon = newest - self.lateness
            still = [r for r in still if r[0] >= horizon]
            samples = samples[bisect_left(at, horizon - self.max_age) :]
        for state, held_rows in ((self.samples, samples), (self.asked, still)):
            state.put(held_rows) if held_rows else state.clear()
        self.newest.update((newest,))
        if out:
            held_col = pd.array([x[1] for x in out], dtype="Float64")
            yield pd.DataFrame({id_col: [x[0] for x in out], "__key": key[0], "held": held_col, "version": [x[2] for x in out], "late": [x[3] for x in out]})

    def close(self) -> None:
        pass


def asof_previous(
    df: DataFrame, key: str, track: str, wanted: str, max_age_s: float, ts: str = "ts", value: str = "value", id_col: str = "event_id", lateness_s: float | None = None
) -> DataFrame:
    """(id, key, held, version, late): for each row of a stream the last value of the wanted track strictly before it, not older than
    `max_age_s`. A sample that comes later than rows after it corrects them: they come again with a greater `version`, so the row of the
    greatest version of an id holds (`drain(..., latest=id_col)`), and the result doesn't depend on the order of files.

    State is list state of a key: its rows and its samples. `lateness_s` bounds it: rows that are older than the key's newest row by
    more than it are final and leave the state, with the samples that only they could use. A row that comes after that is never
    dropped: it is answered from what is held and marked `late`. None keeps everything. Rows with a null id or time aren't allowed."""
    id_kind = dict(df.dtypes)[id_col]
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    src = df.select(id_col, key, F.col(ts).cast("timestamp").alias(ts), track, F.col(value).cast("double").alias(value))
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("__key", df.schema[key].dataType), *StructType.fromDDL("held double, version long, late boolean").fields])
    out = src.groupBy(key).transformWithStateInPandas(_AsOf(wanted, max_age_s, lateness_s, (ts, track, value, id_col), id_kind), schema, "Append", "None")
    return out.withColumnRenamed("__key", key)


def drain(stream: DataFrame, name: str, mode: str = "append", latest: str | None = None) -> DataFrame:
    """Runs a stream over what its source has now and gives its sink's table. In complete mode each micro-batch replaces the
    result, in append mode it has a folder of its own, so that a batch that is run again replaces its first try. With `latest` only the
    row with the greatest `version` of each value of that column is kept."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    write: Callable = lambda b, i: b.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/{i}")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
    if latest:
        rest = [c for c in rows.columns if c != latest]
        rows = rows.groupBy(latest).agg(F.max_by(F.struct(*rest), "version").alias("__r")).select(latest, "__r.*")
    return rows
