"""Quality scores by a sparse rule ensemble.

Statistics of each whole text (`STATS`) are taken in numpy. On a bounded sample of labelled rows boosted trees are grown, every
path from their roots becomes a conjunctive rule over the statistics, and an L1-penalised logistic regression keeps a few
rules with weights; the penalty is the largest whose loss on a held third of the sample is within one percent of the least.
The kept rules are compiled into one Spark column expression over the statistics' columns.

Null texts count as empty; an empty text has all statistics zero and a score like any other. Labels that are null or not 0
or 1, and labels whose document is missing, are not learnt from; a document with several labels counts once for each. Without
usable labels every score is 0.5. The sample has `sample` rows at most in expectation, drawn by the hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from . import trees as G
from ._common import arrow, hash_unit, is_held_out, table

STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "exclaim", "bar", "stop", "high", "letters",
    "distinct_words", "distinct_lines", "line_words", "long_words", "marked_words", "capital_words",
)

_UPPER, _DIGIT, _LETTER, _SYMBOL, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
_STOP[[ord(c) for c in ".,;:?"]] = True


def _distinct(h: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each group has."""
    key = T.mix(h + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    return np.bincount(group[first], minlength=n)


def stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, STATS) of float64."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    data, off = T.spaced(data, off)
    lo, hi = off[:-1], off[1:]
    count = lambda m: T.reduce_sum(m[data], lo, hi, np.int64)
    byte = lambda c: T.reduce_sum(data == c, lo, hi, np.int64)
    some = np.maximum(size, 1)
    start, end = T.runs(~T.BLANK[data])
    doc = np.searchsorted(off, start, side="right") - 1
    words = np.bincount(doc, minlength=n)
    any_word = np.maximum(words, 1)
    wh = T.span_hashes(data, start, end)
    letters = count(_LETTER)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    head = data[start] if len(start) else np.zeros(0, np.uint8)
    breaks = data == 10
    breaks[hi - 1] = True
    ls, le = T.runs(~breaks)
    ldoc = np.searchsorted(off, ls, side="right") - 1
    lines = np.bincount(ldoc, minlength=n)
    out = [
        np.log1p(size), np.log1p(words), (T.reduce_sum(end - start, *_groups(doc, n))) / any_word, count(_UPPER) / np.maximum(letters, 1),
        count(_DIGIT) / some, count(_SYMBOL) / some, byte(33) / some, byte(124) / some, count(_STOP) / some,
        T.reduce_sum(data >= 128, lo, hi, np.int64) / some, letters / some,
        np.where(words > 0, _distinct(wh, doc, n) / any_word, 0), np.where(lines > 0, _distinct(T.span_hashes(data, ls, le), ldoc, n) / np.maximum(lines, 1), 0),
        words / np.maximum(lines, 1), np.bincount(doc[end - start > 16], minlength=n) / any_word,
        np.bincount(doc[_SYMBOL[last]], minlength=n) / any_word, np.bincount(doc[_UPPER[head]], minlength=n) / any_word,
    ]
    return np.stack([x.astype(float) for x in out], axis=1)


def _groups(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(doc, np.arange(n)), np.searchsorted(doc, np.arange(n), side="right")


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns `keep` of `docs` and the statistics of its text, named s_*."""
    src = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    at, names = len(keep), [*keep, *(f"s_{s}" for s in STATS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [stats(d, o) for _, _, d, o in T.slices(b.column(at))]
            x = np.concatenate(got) if got else np.zeros((0, len(STATS)))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:at]]
    return arrow(src, run, ", ".join([*fields, *(f"s_{s} double" for s in STATS)]))


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[float, tuple[tuple[int, str, float], ...]], ...]

    def column(self) -> Column:
        """The score as a column expression over the statistics' columns."""
        terms = [f"{self.bias!r}D"]
        for w, conds in self.rules:
            test = " AND ".join(f"s_{STATS[f]} {op} {t!r}D" for f, op, t in conds)
            terms.append(f"CASE WHEN {test} THEN {w!r}D ELSE 0D END")
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")


def _rule_matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=bool)
    for k, conds in enumerate(rules):
        for f, op, t in conds:
            out[:, k] &= (x[:, f] < t) if op == "<" else (x[:, f] >= t)
    return out


def _lasso(r: np.ndarray, y: np.ndarray, lam: float, start: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights (the first is the bias, without penalty) of the mean logistic loss plus lam times the absolute weights;
    accelerated proximal gradient."""
    z = np.hstack((np.ones((len(r), 1)), r))
    step = 4.0 / max(np.linalg.eigvalsh(z.T @ z / len(z))[-1], 1e-9)
    w = v = start
    t = 1.0
    for _ in range(rounds):
        g = z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y) / len(y)
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lam, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, done = new + (t - 1) / t2 * (new - w), np.abs(new - w).max() < 1e-6
        w, t = new, t2
        if done:
            break
    return w


def _simple(conds: list[tuple[int, str, float]]) -> tuple:
    """The rule with one bound a side for each statistic."""
    best: dict[tuple[int, str], float] = {}
    for f, op, t in conds:
        k = (f, op)
        best[k] = t if k not in best else min(best[k], t) if op == "<" else max(best[k], t)
    return tuple(sorted((f, op, t) for (f, op), t in best.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = 12, depth: int = 3) -> RuleModel:
    """Every path of the trees is a rule: rounds * (2 ** (depth + 1) - 2) at most."""
    if not len(y):
        return RuleModel(0.0, ())
    if y.min() == y.max():
        return RuleModel(4.0 if y[0] else -4.0, ())
    _, trees = G.boost(x, y, rounds=rounds, depth=depth, rate=0.4, least=max(5, len(y) // 400))
    rules = sorted({_simple(p) for t in trees for p in t.paths()}, key=lambda c: (len(c), c))
    if not rules:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return RuleModel(float(np.log(p / (1 - p))), ())
    r = _rule_matrix(x, rules).astype(float)
    held = np.arange(len(y)) % 3 == 2
    if y[~held].min() == y[~held].max():
        held[:] = False
    w, losses = np.zeros(1 + len(rules)), []
    for lam in (0.03, 0.01, 0.003, 0.001, 0.0003):
        w = _lasso(r[~held], y[~held], lam, w)
        z = np.clip(w[0] + r @ w[1:], -30, 30)
        at = held if held.any() else ~held
        losses.append((float(np.mean(np.log1p(np.exp(z[at])) - y[at] * z[at])), lam))
    least = min(losses)[0]
    lam = next(lam for loss, lam in losses if loss <= least * 1.01 + 1e-9)
    w = np.zeros(1 + len(rules))
    for step in (0.03, 0.01, 0.003, 0.001, 0.0003):
        if step >= lam:
            w = _lasso(r, y, step, w)
    return RuleModel(float(w[0]), tuple((float(a), rules[k]) for k, a in enumerate(w[1:]) if abs(a) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8_000, id_col: str = "doc_id", label_col: str = "quality") -> RuleModel:
    """Learns from the labels, which must be those to learn from only."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null")
    n = known.count()
    if n > sample:
        known = known.where(hash_unit(F.col("__id").cast("string"), F.lit("quality")) < sample / n)
    src = docs.select(F.col(id_col).alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))  # `sample` rows
    got = with_stats(src, ("doc_id", "__y")).toArrow()
    x = np.stack([got[f"s_{s}"].to_numpy() for s in STATS], axis=1) if got.num_rows else np.zeros((0, len(STATS)))
    order = np.lexsort((*x.T, got["doc_id"].to_numpy())) if got.num_rows else []
    return fit_rules(x[order], got["__y"].to_numpy().astype(float)[order])


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, score) of each row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_stats(src).select("doc_id", model.column().alias("score"))


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~is_held_out()))
    return score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
