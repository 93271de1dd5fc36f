"""Vector codes: each vector is cut into equal parts, and each part is replaced by the index of its nearest codebook entry.

Components are integers, floor(scale * x). The codebooks come from Lloyd rounds: assign every part to its nearest entry (squared
Euclidean distance, ties to the lower index), then replace each entry by its parts' componentwise floor(sum / count).

Hamerly's bounds spare most scans. With each part its code, one upper bound of the distance to its entry and one lower bound of
the distance to the second nearest are kept in a table between the rounds. A round first moves the bounds by how far the entries
went. A part whose upper bound is strictly below its lower bound (or below half the distance from its entry to the nearest other
one) keeps its code; else its upper bound is made exact, and only if that isn't strictly below either, all entries are compared in
integer arithmetic, where the first least distance is the lowest index. Bounds are rounded outwards, so they never decide a tie.

One pass a round reads the table and writes the next one, with the rounds' sums beside the rows: of a task at most one row an
entry, and after the first round only of parts whose code changed. The driver holds the codebooks (parts x entries x length
numbers), never rows. A task lost costs a re-read of its share.

Defined results. Dropped are vectors that are null, that hold null or non-finite components, or whose length isn't the greatest
one among the rest that `parts` divides. The first entries are the `entries` first rows by id (nulls last), then by vector;
repeated rows count each. Fewer rows: fewer entries. Null ids and null labels are values like any other. An empty table gives no
rows. Further columns don't matter. A component of 2**27 or more after scaling raises an error, as distances would pass a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._common import Scratch, arrow, table

LIMIT = 1 << 27
#: Above any rounding error of a bound's square root and sum.
_SLACK = 1e-12
#: Rows of a part that are compared with all entries at once.
_CHUNK = 4096
#: Rows of the label sums up to which they are broadcast (some 24 bytes each).
BROADCAST_ROWS = 100_000


@dataclass
class Codebooks:
    """books: parts x entries x length, int64. moved: how far each entry went in the last round."""

    books: np.ndarray
    moved: np.ndarray | None = None
    scans: list[int] = field(default_factory=list)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def half_gaps(self) -> np.ndarray:
        """Half the distance from each entry to the nearest other one, rounded down."""
        p, k, _ = self.books.shape
        out = np.full((p, k), np.inf)
        if k > 1:
            for i in range(p):
                d = np.stack([((self.books[i] - e) ** 2).sum(1) for e in self.books[i]]).astype(float)
                np.fill_diagonal(d, np.inf)
                out[i] = np.sqrt(d.min(1)) / 2 * (1 - _SLACK)
        return out


def squared(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of integer vectors."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * v.shape[1] < 1 << 52:  # then every sum below is a whole number that a double holds
        a, b = v.astype(float), book.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return np.stack([((v - e) ** 2).sum(1) for e in book], axis=1)


def scan(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, distance, second-nearest distance) by comparing with all entries; the first of equal distances wins."""
    n = len(v)
    code, near, second = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
    for lo in range(0, n, _CHUNK):
        d = squared(v[lo : lo + _CHUNK], book)
        at = np.arange(len(d))
        code[lo : lo + _CHUNK] = c = d.argmin(1)
        near[lo : lo + _CHUNK] = np.sqrt(d[at, c].astype(float))
        if d.shape[1] > 1:
            d = d.astype(float)
            d[at, c] = np.inf
            second[lo : lo + _CHUNK] = np.sqrt(d.min(1))
    return code, near, second


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + _SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - _SLACK)).astype(np.float32), np.float32(-np.inf))


def assign(v: np.ndarray, books: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, gaps: np.ndarray) -> int:
    """Brings code, upper and lower (rows x parts, changed in place) of v (rows x parts x length) up to the moved entries. Returns
    the number of parts that were compared with all entries."""
    scans = 0
    for p in range(len(books)):
        a, far = code[:, p].astype(np.int64), moved[p]
        # The other entries went at most as far as the farthest one, or as the second farthest for its own parts.
        top = int(far.argmax())
        rest = np.delete(far, top).max(initial=0.0)
        u = (upper[:, p].astype(float) + far[a]) * (1 + _SLACK)
        low = lower[:, p].astype(float) - np.where(a == top, rest, far[top])
        low = low * np.where(low > 0, 1 - _SLACK, 1 + _SLACK)
        safe = np.maximum(low, gaps[p][a])
        at = np.flatnonzero(~(u < safe))
        if len(at):
            d = np.sqrt(((v[at, p] - books[p][a[at]]) ** 2).sum(1).astype(float)) * (1 + _SLACK)
            u[at] = d
            at = at[~(d < safe[at])]
        if len(at):
            code[at, p], u[at], low[at] = scan(v[at, p], books[p])
            scans += len(at)
        upper[:, p], lower[:, p] = _up(u), np.where(low > 0, _down(np.maximum(low, 0)), np.nextafter(low.astype(np.float32), np.float32(-np.inf)))
    return scans


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of equal length as a list column."""
    n, w = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(x).ravel(), type=kind))


def _rows(col: pa.Array, width: int) -> np.ndarray:
    flat = col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _schema(df: DataFrame, carry: list[str], extra: str) -> StructType:
    head = [StructField(c, df.schema[c].dataType) for c in carry]  # null in the rows of sums
    return StructType([*head, *StructType.fromDDL(extra).fields])


_STATE = "__v array<int>, __code binary, __upper array<float>, __lower array<float>, __part int, __entry int, __n long, __scans long, __sums array<long>"


def _round(book: Codebooks, carry: list[str], scale: int, first: bool):
    books, moved, gaps = book.books, book.moved, book.half_gaps()
    p, k, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of, sums, scans, kinds = np.zeros((p, k), np.int64), np.zeros((p, k, w), np.int64), 0, None

        def count(v: np.ndarray, code: np.ndarray, sign: int) -> None:
            for i in range(p):
                n_of[i] += sign * np.bincount(code[:, i], minlength=k)
                for j in range(w):
                    sums[i, :, j] += sign * np.bincount(code[:, i], weights=v[:, i, j], minlength=k).astype(np.int64)

        for b in batches:
            kinds = [b.schema.field(c).type for c in carry]
            for lo in range(0, b.num_rows, 1 << 15):
                s = b.slice(lo, 1 << 15)
                n = s.num_rows
                if first:
                    x = np.floor(_rows(s.column("__v"), p * w).astype(float) * scale)
                    if np.abs(x).max(initial=0) >= LIMIT:
                        raise ValueError("a component is too large for exact distances")
                    v = x.astype(np.int64).reshape(n, p, w)
                    code, upper, lower = np.zeros((n, p), np.int64), np.zeros((n, p)), np.zeros((n, p))
                    for i in range(p):
                        code[:, i], upper[:, i], lower[:, i] = scan(v[:, i], books[i])
                    upper, lower, scans = _up(upper), _down(lower), scans + n * p
                    count(v, code, 1)
                else:
                    v = _rows(s.column("__v"), p * w).astype(np.int64).reshape(n, p, w)
                    old = np.frombuffer(b"".join(s.column("__code").to_pylist()), np.uint8).reshape(n, p).astype(np.int64)
                    code, upper, lower = old.copy(), _rows(s.column("__upper"), p).copy(), _rows(s.column("__lower"), p).copy()
                    scans += assign(v, books, code, upper, lower, moved, gaps)
                    at = np.flatnonzero((code != old).any(1))
                    count(v[at], old[at], -1)
                    count(v[at], code[at], 1)
                raw = np.ascontiguousarray(code, np.uint8)
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
                kept = [s.column(c) for c in carry]
                yield pa.RecordBatch.from_arrays(
                    [*kept, _lists(v.reshape(n, -1), pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), *none],
                    names=[*carry, "__v", "__code", "__upper", "__lower", "__part", "__entry", "__n", "__scans", "__sums"],
                )
        at = np.argwhere((n_of != 0) | (sums != 0).any(2))
        if kinds and (len(at) or scans):
            at = at if len(at) else np.zeros((1, 2), np.int64)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.nulls(n, t) for t in kinds), *(pa.nulls(n, t) for t in (pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()))),
                    pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(n_of[at[:, 0], at[:, 1]]), pa.array([scans] + [0] * (n - 1), pa.int64()), _lists(sums[at[:, 0], at[:, 1]], pa.int64()),
                ],
                names=[*carry, "__v", "__code", "__upper", "__lower", "__part", "__entry", "__n", "__scans", "__sums"],
            )

    return run


def _last(book: Codebooks, carry: list[str]):
    """The assignment to the final entries: codes and the exact squared distance over all parts."""
    books, moved, gaps = book.books, book.moved, book.half_gaps()
    p, _, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows(b.column("__v"), p * w).astype(np.int64).reshape(-1, p, w)
            code = np.frombuffer(b"".join(b.column("__code").to_pylist()), np.uint8).reshape(-1, p).astype(np.int64)
            assign(v, books, code, _rows(b.column("__upper"), p).copy(), _rows(b.column("__lower"), p).copy(), moved, gaps)
            error = sum(((v[:, i] - books[i][code[:, i]]) ** 2).sum(1) for i in range(p))
            raw = np.ascontiguousarray(code, np.uint8)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(error, pa.int64())], names=[*carry, "code", "error"])

    return run


def sound(vector: str | Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", carry: list[str] | None = None, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """(rows of id, the columns `carry`, code as `parts` bytes and error; the final codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    spark, keep = df.sparkSession, list(dict.fromkeys([id, *(carry or [])]))
    scratch = Scratch(spark, "vector-codes")
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("__v")).where(sound("__v"))
    width = rows.where(F.size("__v") % parts == 0).agg(F.max(F.size("__v"))).first()[0]
    if not width:  # no rows, or only empty vectors, which are all alike
        code = F.lit(bytes(parts)).alias("code")
        return rows.where(F.size("__v") == 0).select(*keep, code, F.lit(0).cast("long").alias("error")), Codebooks(np.zeros((parts, 1, 0), np.int64))
    rows = rows.where(F.size("__v") == width)
    seeds = rows.orderBy(F.col(id).asc_nulls_last(), "__v").limit(entries).select("__v").collect()
    books = np.floor(np.array([r[0] for r in seeds], dtype=float) * scale)
    if np.abs(books).max(initial=0) >= LIMIT:
        raise ValueError("a component is too large for exact distances")
    book = Codebooks(np.ascontiguousarray(books.astype(np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)))
    p, k, w = book.books.shape
    total, n_of = np.zeros((p, k, w), object), np.zeros((p, k), object)
    state, schema = rows, _schema(rows, keep, _STATE)
    for r in range(rounds):
        new = scratch.keep(arrow(state, _round(book, keep, scale, r == 0), schema), f"round{r}")
        part = new.where(F.col("__part").isNotNull()).groupBy("__part", "__entry")
        wide = [F.sum(F.col("__sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(w)]
        scans = 0
        for s in part.agg(F.sum("__n").alias("n"), F.sum("__scans").alias("scans"), *wide).collect():  # at most a row an entry
            n_of[s[0], s[1]] += int(s["n"])
            scans += int(s["scans"])
            for j in range(w):
                total[s[0], s[1], j] += int(s[f"s{j}"])
        nxt = book.books.copy()
        for i, j in np.argwhere(n_of > 0):
            nxt[i, j] = [int(x) // int(n_of[i, j]) for x in total[i, j]]
        far = np.sqrt(((nxt - book.books) ** 2).sum(2).astype(float)) * (1 + _SLACK)
        book = Codebooks(nxt, far, [*book.scans, scans])
        if r:
            scratch.drop(state_table)
        state_table = new
        state = new.where(F.col("__part").isNull()).select(*keep, "__v", "__code", "__upper", "__lower")
    if not rounds:
        raise ValueError("at least one round")
    out = scratch.keep(arrow(state, _last(book, keep), _schema(rows, keep, "code binary, error long")), "codes")
    scratch.drop(state_table)
    return out, book


def decode(codes: DataFrame, book: Codebooks, scale: int = 1024, out: str = "vector") -> DataFrame:
    """Adds the vectors that the codes stand for."""
    p, k, w = book.books.shape
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x) / scale) for x in e]) for e in b]) for b in book.books])
    digit = lambda i: F.conv(F.hex(F.substring("code", i + 1, 1)), 16, 10).cast("int")
    return codes.withColumn(out, F.concat(*[entries[i][digit(i)] for i in range(p)]))


def with_sums(rows: DataFrame, by: str, x: str, out: str) -> DataFrame:
    """Adds the sum of x over the rows with the same value of `by`, nulls together. The sums are broadcast where a count shows them
    to be few; else the join is left to adaptive execution, which splits hot keys."""
    sums = rows.groupBy(F.col(by).alias("__by")).agg(F.sum(x).alias(out))
    if len(sums.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 4 parts, 256 entries, 4 rounds."""
    codes, book = compress(table(spark, sf_dir, "embeddings"), carry=["label"])
    rows = with_sums(codes, "label", "error", "label_error")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    far = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
    near = lambda r: f"""a{r} AS MATERIALIZED (
  SELECT a.n, a.part, arg_min(b.entry, ({far}) * {entries} + b.entry) AS entry, min({far}) AS d
  FROM cut a JOIN b{r} b ON a.part = b.part GROUP BY a.n, a.part)"""  # noqa: E731
    mean = lambda r: f"""m{r} AS MATERIALIZED (
  SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS v FROM (
    SELECT a.part, a.entry, i, sum(c.v[i])::BIGINT AS s, count(*) AS c FROM a{r} a JOIN cut c ON a.n = c.n AND a.part = c.part, unnest(range(1, len(c.v) + 1)) AS t(i)
    GROUP BY a.part, a.entry, i) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)"""  # noqa: E731
    steps = ",\n".join(s for r in range(rounds) for s in (near(r), mean(r)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
cut AS MATERIALIZED (SELECT n, p.part, v[p.part * (len(v) // {parts}) + 1 : (p.part + 1) * (len(v) // {parts})] AS v FROM kept, unnest(range({parts})) AS p(part)),
b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, v FROM cut WHERE n <= {entries}),
{steps},
{near(rounds)},
done AS (SELECT k.vec_id, k.label, string_agg(format('{{:02x}}', a.entry), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error
  FROM a{rounds} a JOIN kept k USING (n) GROUP BY k.n, k.vec_id, k.label),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM done
"""


OP11_SQL = _sql()
