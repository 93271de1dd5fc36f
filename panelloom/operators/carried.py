"""Scans along time whose state is carried over task borders, so that an entity of any length spreads over tasks.

A scan gives each row a state that follows from the row before it. Rows are dealt by ranges of (keys, order); a task goes through its
range in order, several entities or a piece of one. What happens to the state along rows is a composition of maps, and maps compose
before the state is known:

* `Affine`: y <- M y + b. The composition of two affine maps is one.
* `Finite`: a state out of a few, s <- table[s]. The composition of two tables is one.

A task composes the maps of its rows by a segmented scan in log2(rows) vectorised steps. Only its first entity may have begun in an
earlier task; for that entity's rows it writes the composed maps, for all others the results. Besides it reports its first and its
last row and what it does to the state: one row a task. The driver walks over these few rows in task order, which gives each task's
incoming state, and a join on the task's number (a row a task, so broadcast) finishes the rows. The dealt rows are shuffled once and
written to the shared folder; nothing holds an entity's rows together.

Maps may depend on the row before: `step(before, here)` gets the columns of both. `start(here)` gives an entity's first state. Null keys
are an entity like any other; rows with equal keys and order are taken in any order, so `order` should be total."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.io import scratch

Columns = dict[str, np.ndarray]
#: Rows of a task, about.
ROWS = 500_000
#: Tasks at most: the driver walks over a row of each.
TASKS = 100_000
#: Rows that are composed together.
_BATCH = 8_192


@dataclass(frozen=True)
class Affine:
    """y <- M y + b of `size` numbers. step gives (M: n x size x size, b: n x size), start gives n x size; the outputs are the rows of
    `weights` (outputs x size) times the state."""

    size: int
    step: Callable[[Columns, Columns], tuple[np.ndarray, np.ndarray]]
    start: Callable[[Columns], np.ndarray]
    weights: tuple[tuple[float, ...], ...]

    def identity(self, n: int) -> list[np.ndarray]:
        return [np.repeat(np.eye(self.size)[None], n, 0), np.zeros((n, self.size))]

    def constant(self, state: np.ndarray) -> list[np.ndarray]:
        return [np.zeros((len(state), self.size, self.size)), state]

    def maps(self, before: Columns, here: Columns) -> list[np.ndarray]:
        m, b = self.step(before, here)
        return [np.array(np.broadcast_to(m, (len(b), self.size, self.size)), dtype=float), np.array(b, dtype=float)]

    def after(self, late: list[np.ndarray], early: list[np.ndarray]) -> list[np.ndarray]:
        """The maps `late` after `early`, row by row."""
        return [late[0] @ early[0], (late[0] @ early[1][:, :, None])[:, :, 0] + late[1]]

    def apply(self, maps: list[np.ndarray], state: np.ndarray) -> np.ndarray:
        return (maps[0] @ state[None, :, None])[:, :, 0] + maps[1]

    def given(self, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(outputs without an incoming state: n x outputs; what one adds: n x (outputs * size))."""
        w = np.array(self.weights)
        return maps[1] @ w.T, (w[None] @ maps[0]).reshape(len(maps[1]), -1)

    def finish(self, z: str, w: str, state: str, k: int):
        one = lambda j: F.col(w)[k * self.size + j] * F.col(state)[j]
        total = F.col(z)[k]
        for j in range(self.size):
            total = total + one(j)
        return total


@dataclass(frozen=True)
class Finite:
    """s <- table[s] of the states 0 … size - 1. step gives tables (n x size), start gives n states; the output is values[s]."""

    size: int
    step: Callable[[Columns, Columns], np.ndarray]
    start: Callable[[Columns], np.ndarray]
    values: tuple[float, ...]

    @property
    def weights(self) -> tuple:
        return (self.values,)

    def identity(self, n: int) -> list[np.ndarray]:
        return [np.repeat(np.arange(self.size, dtype=np.int64)[None], n, 0)]

    def constant(self, state: np.ndarray) -> list[np.ndarray]:
        return [np.repeat(np.asarray(state, np.int64).reshape(-1, 1), self.size, 1)]

    def maps(self, before: Columns, here: Columns) -> list[np.ndarray]:
        return [np.array(self.step(before, here), dtype=np.int64)]

    def after(self, late: list[np.ndarray], early: list[np.ndarray]) -> list[np.ndarray]:
        return [np.take_along_axis(late[0], early[0], 1)]

    def apply(self, maps: list[np.ndarray], state: np.ndarray) -> np.ndarray:
        return maps[0][:, int(state.ravel()[0])][:, None].astype(float)

    def given(self, maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(the outputs where all states give the same one, the outputs by incoming state)."""
        out = np.array(self.values)[maps[0]]
        return out[:, :1], out

    def finish(self, z: str, w: str, state: str, k: int):
        return F.element_at(F.col(w), (F.col(state)[0] + 1).cast("int"))


def composed(kind: Affine | Finite, maps: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """Inclusive compositions within segments; first: whether a row begins one."""
    n, step = len(first), 1
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while step < n:
        at = np.flatnonzero(np.arange(n) - step >= begin)
        if not len(at):
            break
        new = kind.after([m[at] for m in maps], [m[at - step] for m in maps])
        for m, x in zip(maps, new, strict=True):
            m[at] = x
        step *= 2
    return maps


def _take(here: Columns, at) -> Columns:
    return {c: v[at] for c, v in here.items()}


def _differs(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before (the first row: true)."""
    out = np.zeros(batch.num_rows, dtype=bool)
    out[:1] = True
    for c in keys:
        code = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def _numbers(batch: pa.RecordBatch, need: list[str]) -> Columns:
    """The columns as doubles; null is NaN."""
    return {c: batch.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in need}


def scan(df: DataFrame, keys: list[str], order: list[str], kind: Affine | Finite, need: list[str], out: list[str], carry: list[str] | None = None, descending: bool = False, rows_per_task: int = ROWS) -> DataFrame:
    """(keys, order, the columns `carry`, out): `kind` along each entity's rows, or back from their end. need: the numeric columns
    that step and start get."""
    spark = df.sparkSession
    kept = list(dict.fromkeys([*keys, *order, *(carry or [])]))
    used = list(dict.fromkeys([*kept, *need]))
    rows = df.select(*used)
    tasks = min(TASKS, max(1, -(-rows.select(keys).count() // rows_per_task)))
    by = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in dict.fromkeys([*keys, *order])]
    dealt = (rows.repartitionByRange(tasks, *by) if tasks > 1 else rows.coalesce(1)).sortWithinPartitions(*by).withColumn("__task", F.spark_partition_id())
    head = [StructField(c, df.schema[c].dataType) for c in kept]  # null in the rows about a task
    ends = ", ".join(f"`__{e}_{c}` double" for e in ("first", "last") for c in need)
    spec = StructType([*head, *StructType.fromDDL("__task int, __z array<double>, __w array<double>, __last boolean, __runs long, __map array<double>").fields, *StructType.fromDDL(ends).fields])
    names, n_out, width = [f.name for f in spec.fields], len(kind.weights), len(kind.weights) * kind.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_row = last_key = first_row = first_key = None
        runs, carry_map, task, kinds = 0, None, 0, {}
        for whole in batches:
            for lo in range(0, whole.num_rows, _BATCH):
                b = whole.slice(lo, _BATCH)
                n = b.num_rows
                kinds = {f.name: f.type for f in b.schema}
                here, new = _numbers(b, need), _differs(b, keys)
                key0 = [b.column(k)[0] for k in keys]
                before = {c: np.concatenate(([np.nan if last_row is None else last_row[c]], v[:-1])) for c, v in here.items()}
                if last_row is None:
                    first_row, first_key, task = {c: float(v[0]) for c, v in here.items()}, b.slice(0, 1).select(keys), b.column("__task")[0].as_py()
                elif all(x.equals(y) for x, y in zip(key0, last_key, strict=True)):
                    new[0] = False
                maps = kind.maps(before, here)
                begins = kind.constant(kind.start(_take(here, new)))
                for m, x in zip(maps, begins, strict=True):
                    m[new] = x
                if last_row is None:  # what comes before isn't known here: the rest follows from this row's own state
                    for m, x in zip(maps, kind.identity(1), strict=True):
                        m[0] = x[0]
                seg = new.copy()
                seg[0] = True
                maps = composed(kind, maps, seg)
                if carry_map is not None and not new[0]:
                    end = int(np.flatnonzero(new)[0]) if new.any() else n
                    part = kind.after([m[:end] for m in maps], [np.repeat(m, end, 0) for m in carry_map])
                    for m, x in zip(maps, part, strict=True):
                        m[:end] = x
                opens = np.cumsum(new) + runs - (1 if last_row is None else 0) == 0  # rows of the task's first entity
                runs += int(new.sum()) - (1 if last_row is None else 0)
                z, w = kind.given(maps)
                at = np.concatenate(([0], np.cumsum(np.where(opens, width, 0)))).astype(np.int32)
                w_col = pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(w[opens]).ravel()), mask=pa.array(~opens))
                z_col = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_out), pa.array(np.ascontiguousarray(z, dtype=float).ravel()))
                none = [pa.nulls(n, t) for t in (pa.bool_(), pa.int64(), pa.list_(pa.float64()), *[pa.float64()] * (2 * len(need)))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), b.column("__task"), z_col, w_col, *none], names=names)
                carry_map = [m[-1:].copy() for m in maps]
                last_row, last_key = {c: float(v[-1]) for c, v in here.items()}, [b.column(k)[n - 1] for k in keys]
        if last_row is None:
            return
        # Two rows about the task: its first and its last entity, with the numbers of the row at that end.
        flat = np.concatenate([m.ravel() for m in carry_map]).astype(float).tolist()
        for is_last, key in ((False, [first_key.column(k)[0] for k in keys]), (True, last_key)):
            of = dict(zip(keys, key, strict=True))
            cols = [pa.array([of[c].as_py()], kinds[c]) if c in of else pa.nulls(1, kinds[c]) for c in kept]
            cols += [pa.array([task], pa.int32()), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.list_(pa.float64())), pa.array([is_last]), pa.array([runs], pa.int64()), pa.array([flat], pa.list_(pa.float64()))]
            cols += [pa.array([x[c]], pa.float64()) for x in (first_row, last_row) for c in need]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    path = scratch(spark, "carried")
    dealt.mapInArrow(run, spec).write.option("compression", "zstd").parquet(path)
    done = spark.read.schema(spec).parquet(path)
    states = _walk(kind, keys, need, done.where("__last is not null").orderBy("__task", "__last").collect())  # two rows a task
    held = spark.createDataFrame([(t, [float(x) for x in s]) for t, s in states.items()], "__task int, __s array<double>")
    rows = done.where("__last is null").join(F.broadcast(held), "__task", "left")
    cols = [F.when(F.col("__w").isNull(), F.col("__z")[k]).otherwise(kind.finish("__z", "__w", "__s", k)).alias(o) for k, o in enumerate(out)]
    return rows.select(*kept, *cols)


def _walk(kind: Affine | Finite, keys: list[str], need: list[str], ends: list) -> dict[int, np.ndarray]:
    """The state after the first row of each task."""
    same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))
    states, key, row, state = {}, None, None, None
    for i in range(0, len(ends), 2):
        first, last = ends[i], ends[i + 1]
        one = {c: np.array([first[f"__first_{c}"]], dtype=float) for c in need}
        here = [first[k] for k in keys]
        if key is not None and same(key, here):
            s = kind.apply(kind.maps(row, one), state)[0]
        else:
            s = np.atleast_1d(np.asarray(kind.start(one), dtype=float)[0])
        states[first["__task"]] = s
        shape = [m.shape for m in kind.identity(1)]
        flat, maps = np.array(last["__map"]), []
        for sh in shape:
            size = int(np.prod(sh))
            maps.append(flat[:size].reshape(sh))
            flat = flat[size:]
        maps = [m.astype(np.int64) for m in maps] if isinstance(kind, Finite) else maps
        state = kind.apply(maps, s)[0]  # a constant map where the last entity began within the task
        key, row = [last[k] for k in keys], {c: np.array([last[f"__last_{c}"]], dtype=float) for c in need}
    return states
