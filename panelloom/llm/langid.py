"""Language mixtures: expectation-maximisation over n-gram likelihoods, language set by penalised likelihood.

`fit` counts hashed byte trigrams of words (A-Z lowered, everything but letters and non-ASCII bytes is a word end) for each
language over a bounded sample of labelled rows. `mixtures` cuts each whole text into segments of `span` words, takes each
segment's log-likelihood under every language, and estimates the languages' proportions by expectation-maximisation over
the segments. Of the sets that are grown in the order of the proportions, up to all languages, the one with the largest
likelihood less the penalty for its size is chosen, for each text alone; the proportions are those of that set.

Null texts, and texts without a letter, have the language `und`, score 0 and an empty mixture. Ties go to the language that
sorts first. With no labelled row at all every text is `und`. A text that is too short to tell still gets the likeliest
language. Labels may be null (not learnt from). The sample is `docs_per_language` rows a language at most, in
expectation, drawn by the hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import arrow, bounded_fraction, hash_unit, is_held_out, table

BITS = 16
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram that ends at each byte, whether it counts, whether a word starts) over the texts with a
    space after each."""
    data, off = T.spaced(data, off)
    c = _FOLD[data] if len(data) else data
    a = np.concatenate(([32, 32], c)).astype(np.uint32)
    key = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    key[off[:-1]] = np.uint32(0x202000) | c[off[:-1]]  # not the letter that ends the text before
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    letter = c != 32
    before = np.concatenate(([False], letter[:-1]))
    return bucket, letter | before, letter & ~before


def fit(labelled: DataFrame, docs_per_language: int = 3000, id_col: str = "doc_id", smoothing: float = 0.1) -> dict:
    """{"langs": [...], "table": float32 array of (buckets + 1, languages)}; the last row is for what doesn't count."""
    rows = labelled.where("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "table": np.zeros(((1 << BITS) + 1, 0), np.float32)}
    share = bounded_fraction(counts, docs_per_language)
    unit = hash_unit(F.col(id_col).cast("string"), F.lit("langid"))
    if any(f < 1 for f in share.values()):
        pick = F.lit(False)
        for lang, f in share.items():
            pick = pick | ((F.col("lang") == lang) & (unit < f))
        rows = rows.where(pick)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            tags = b.column(0).to_pylist()
            for first, end, data, off in T.slices(b.column(1)):
                bucket, counts_, _ = grams(data, off)
                edge = off + np.arange(len(off))
                for k in range(end - first):
                    at = slice(edge[k], edge[k + 1])
                    t = total.setdefault(tags[first + k], np.zeros(1 << BITS, np.int64))
                    part = bucket[at][counts_[at]]
                    np.add.at(t, part, 1)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(t[at])], names=["lang", "bucket", "n"])

    part = arrow(rows.select(F.col("lang").cast("string"), F.col("text").cast("string")), run, "lang string, bucket long, n long")
    got = part.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    n = np.zeros((1 << BITS, len(langs)))
    col = np.array([langs.index(x) for x in got["lang"].to_pylist()], dtype=np.int64)
    n[got["bucket"].to_numpy(), col] = got["n"].to_numpy()
    logp = np.log((n + smoothing) / (n.sum(0) + smoothing * len(n)))
    return {"langs": langs, "table": np.vstack((logp, np.zeros(len(langs)))).astype(np.float32)}


def _em(ll: np.ndarray, w: np.ndarray, on: np.ndarray, doc: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text; `on` are the languages it may use."""
    pi = on / on.sum(1, keepdims=True)
    total = np.add.reduceat(w, start)
    for r in range(rounds + 1):
        with np.errstate(divide="ignore"):
            x = ll + np.log(pi)[doc]
        top = x.max(1, keepdims=True)
        p = np.exp(x - top)
        s = p.sum(1, keepdims=True)
        if r == rounds:
            return pi, np.add.reduceat((top + np.log(s))[:, 0], start)
        pi = np.add.reduceat(p / s * w[:, None], start, axis=0) / total[:, None]


def estimate(data: np.ndarray, off: np.ndarray, model: dict, span: int = 8, rounds: int = 12, penalty: float = 2.0) -> np.ndarray:
    """Proportions (texts x languages); a row of zeros where no segment has a letter."""
    n, langs = len(off) - 1, len(model["langs"])
    out = np.zeros((n, langs))
    if not langs or not len(data):
        return out
    bucket, counts, first = grams(data, off)
    edge = off + np.arange(n + 1)
    at = np.flatnonzero(first)
    lo, hi = np.searchsorted(at, edge[:-1]), np.searchsorted(at, edge[1:])
    n_seg = -(-(hi - lo) // span)
    if not n_seg.any():
        return out
    has = np.flatnonzero(n_seg)
    seg_first = np.repeat(lo[has], n_seg[has]) + span * T.ranges(np.zeros(len(has), np.int64), n_seg[has])
    start = at[seg_first]
    seg_doc = np.repeat(np.arange(len(has)), n_seg[has])
    doc_start = np.cumsum(n_seg[has]) - n_seg[has]
    bucket[~counts] = 1 << BITS
    ll = np.add.reduceat(model["table"][bucket], start, axis=0, dtype=np.float64)
    w = np.add.reduceat(counts, start, dtype=np.float64)
    base = np.ones((len(has), langs), dtype=bool)
    pi, _ = _em(ll, w, base, seg_doc, doc_start, rounds)
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1, kind="stable")
    weight = np.add.reduceat(w, doc_start)
    price = penalty * np.log(weight + 1)
    most = np.add.reduceat(ll.max(1), doc_start)  # no set of languages has a larger likelihood
    best, score = _em(ll, w, rank < 1, seg_doc, doc_start, 0)
    for k in range(2, langs + 1):
        on = most - price * (k - 1) > score
        if not on.any():
            break
        seg = on[seg_doc]
        p, like = _em(ll[seg], w[seg], rank[on] < k, (np.cumsum(on) - 1)[seg_doc[seg]], np.cumsum(n_seg[has][on]) - n_seg[has][on], rounds)
        value = like - price[on] * (k - 1)
        at = np.flatnonzero(on)[value > score[on]]
        best[at], score[at] = p[value > score[on]], value[value > score[on]]
    out[has] = best
    return out


def _lettered(col: pa.Array, data: np.ndarray, off: np.ndarray, first: int) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are looked at one by one."""
    low = data | np.uint8(32)
    has = T.reduce_sum((low >= 97) & (low <= 122), off[:-1], off[1:], np.int64) > 0
    for k in np.flatnonzero(~has & (np.diff(off) > 0)):
        has[k] = any(c.isalpha() for c in col[first + int(k)].as_py())
    return has


def mixtures(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, lettered, mixture): the language with the largest share, its share, whether the text has
    a letter, and all shares above 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_predict(b.column(1), held.value)], names=["doc_id", *_NEW])

    return arrow(src, run, "doc_id long, lang_pred string, score double, lettered boolean, mixture map<string,double>")


_NEW = ["lang_pred", "score", "lettered", "mixture"]


def _predict(col: pa.Array, model: dict) -> list[pa.Array]:
    langs, pred, score, lettered, mix = model["langs"], [], [], [], []
    for first, end, data, off in T.slices(col):
        shares = estimate(data, off, model)
        has = _lettered(col, data, off, first)
        lettered.extend(has.tolist())
        for k in range(end - first):
            row = shares[k]
            top = int(row.argmax()) if len(langs) else 0
            if not has[k] or not len(langs) or row[top] <= 0:
                pred.append("und"), score.append(0.0), mix.append([])
            else:
                pred.append(langs[top]), score.append(float(min(1.0, row[top])))
                mix.append([(langs[j], float(row[j])) for j in np.flatnonzero(row > 1e-6)])
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.map_(pa.string(), pa.float64())]
    return [pa.array(x, k) for x, k in zip((pred, score, lettered, mix), kinds, strict=True)]


def keep_identified(docs: DataFrame, model: dict, min_share: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a letter and whose main language has a share of
    `min_share` at least (the share is only asked for if the model knows a language)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            _, score, lettered, _ = _predict(b.column(at), model)
            keep = lettered.to_numpy(zero_copy_only=False)
            if model["langs"]:
                keep = keep & (score.to_numpy() >= min_share)
            yield b.filter(pa.array(keep))

    return arrow(docs, run, docs.schema)


def _shares() -> Column:
    """The mixture as text, languages in order: "en=0.9000,fr=0.1000"."""
    entry = lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))
    return F.array_join(F.transform(F.sort_array(F.map_entries("mixture")), entry), ",")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~is_held_out()))
    return mixtures(docs, model).select(
        "doc_id", is_held_out().alias("held_out"), "lang_pred", "score", _shares().alias("shares")
    )
