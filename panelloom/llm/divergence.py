"""Source divergence audit: how far the word use of each source is from every other source's and from its language's.

A term is a run of letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased. Each language keeps the terms in at least
`min_docs` of its documents (V terms). A group (language, source), and each language, gives a kept term with n occurrences
p = 1 + floor(scale * (n + smooth) / (N + smooth * V)), N being the sum of n; all in whole numbers.

Counting: one pass over the texts. A task splits slices of bytes into terms, tells them apart by Arrow's dictionary, and sends per
slice one row a (language, source, term) with its occurrences and documents; Spark adds these up before and after the shuffle.
What follows works on that table, whose size is that of the vocabularies, not of the texts.

Pairs of sources: a term that neither source has adds |p0 - p0'| (the baselines, n = 0), one that only one has adds |p - p0'|. So a
pair's sum is V * |p0 - p0'|, plus for each source's own terms what they add beyond the baseline, plus a correction for the terms
that both have. Terms are dealt into buckets of some `CELLS` cells each; a bucket's task adds its terms' corrections to one matrix
of source pairs, a tile of sources at a time, and sends the sums: no row is made for a pair of cells.

Ranking of terms is a radix select over the table: per group a histogram of the value's highest bits, then of the next ones among
the rows in the digit that holds the kth largest value, and so on, gives each group's threshold. Rows above it are in; of the rows
at it, as many as are left, by the bytes of the term: the same histograms, by one byte after the other, until the rows left are at
most `FEW` a group. No group's rows are sorted or brought together.

Defined results. Null texts, languages and sources are ''. Every (language, source) that occurs is a group, with or without terms.
Documents count once for each term; repeated rows are documents each. A language without kept terms has V = 0: its pairs have the
value 0, and it has no `term` rows. A source that is alone in its language has no `pair` rows. Equal values are ranked by the
item's UTF-8 bytes. Empty tables give no rows. Further columns don't matter; very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._common import Scratch, arrow, table

#: Bytes of a term, the letters and the bytes of characters beyond ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

#: Cells (language, source, term) of a bucket, about; a term's cells stay together.
CELLS = 50_000
#: Sources of a tile of the pair matrix.
TILE = 1_024
#: Rows up to which a table of groups is broadcast.
BROADCAST_ROWS = 50_000
#: Bits of a radix digit.
DIGIT = 10
#: Rows a group up to which tied terms are ranked by a window.
FEW = 1_024


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        groups = pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["l", "s"])
        keys = [c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (b.column(0), b.column(1))]
        _, one, group_of = np.unique(keys[0] * (b.num_rows + 1) + keys[1], return_index=True, return_inverse=True)
        for lo, hi, data, off in T.slices(b.column(2), 4 << 20):
            wide, new = T.spaced(data, off)
            inside = LETTER[wide]
            start, end = T.runs(inside)
            ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
            letters = T.LOWER[wide[inside]]
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
            doc, term, n_terms = np.searchsorted(new, start, side="right") - 1, words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
            pair, n = np.unique(doc * n_terms + term, return_counts=True)  # (document, term)
            cells, at = np.unique(group_of[lo + pair // n_terms] * n_terms + pair % n_terms, return_inverse=True)
            total, docs = np.bincount(at, weights=n, minlength=len(cells)).astype(np.int64), np.bincount(at, minlength=len(cells))
            seen = np.unique(group_of[lo:hi])
            own, zero = groups.take(pa.array(one[np.concatenate((cells // n_terms, seen))])), np.zeros(len(seen), np.int64)
            terms = pa.concat_arrays([words.dictionary.take(pa.array(cells % n_terms)), pa.array([b""] * len(seen), pa.large_binary())])
            yield pa.RecordBatch.from_arrays(
                [own.field(0), own.field(1), terms.cast(pa.binary()).cast(pa.string()), pa.array(np.concatenate((total, zero)), pa.int64()), pa.array(np.concatenate((docs, zero)), pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )


def counted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) of all documents; the row with an empty term stands for the group itself."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(none(lang).alias("lang"), none(source).alias("source"), none(text).alias("text"))
    found = arrow(rows, _counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * terms)) in whole numbers of any size; null without terms."""
    big = lambda c: c.cast("decimal(28,0)")
    return _div(big(n + smooth) * scale, big(total + smooth * terms)) + 1


def _div(a: Column, b: Column) -> Column:
    """Floor of a / b of decimals that are not negative; null where b is 0."""
    return F.call_function("div", a.cast("decimal(38,0)"), F.nullif(b.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast, if a count of at most BROADCAST_ROWS + 1 rows shows that the table is small; else left to adaptive execution."""
    return F.broadcast(df) if len(df.limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) <= BROADCAST_ROWS else df


def shares(found: DataFrame, scratch: Scratch, min_docs: int, smooth: int, scale: int) -> tuple[DataFrame, DataFrame]:
    """(cells: lang, source, term, n, p, q; groups: lang, source, total, terms, base), written."""
    found = scratch.keep(found, "counts")
    by_term = found.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("__docs"), F.sum("n").alias("lang_n"))
    kept = scratch.keep(by_term.where(F.col("__docs") >= min_docs).drop("__docs"), "kept")
    cells = scratch.keep(found.where("n > 0").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept_cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = found.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(_small(langs), "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("terms"), zero("lang_total"))
    groups = scratch.keep(groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms"), smooth, scale)), "groups")
    cells = cells.join(_small(groups), ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("terms"), smooth, scale)
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smooth, scale)
    return scratch.keep(cells.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "cells"), groups


def bucket_sums(no: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray, tile: int = TILE) -> Iterator[tuple[int, int, np.ndarray]]:
    """For tiles of sources (first row, first column, matrix): what the bucket's cells add to each pair's sum beyond the baseline,
    V * |base - base'|. no: the source's number of each cell."""
    order = np.lexsort((p, no))
    cut, sorted_p = np.searchsorted(no[order], np.arange(len(base) + 1)), p[order]
    by = np.argsort(term, kind="stable")
    no, term, p = no[by], term[by], p[by]
    first = np.flatnonzero(np.concatenate(([True], np.diff(term) != 0, [True])))
    both = [(a, z) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if z - a > 1]

    def alone(a: int, b: int) -> np.ndarray:
        """Of the terms of a tile's sources, against another tile's baselines: by sorted shares and their running sums."""
        other = base[b : b + tile]
        out = np.zeros((len(base[a : a + tile]), len(other)), np.int64)
        for g in range(len(out)):
            x = sorted_p[cut[a + g] : cut[a + g + 1]]
            upto, k = np.concatenate(([0], np.cumsum(x))), np.searchsorted(x, other)
            out[g] = other * k - upto[k] + (upto[-1] - upto[k]) - other * (len(x) - k) - len(x) * np.abs(base[a + g] - other)
        return out

    for a in range(0, len(base), tile):
        for b in range(a, len(base), tile):
            out = alone(a, b) + alone(b, a).T
            for lo, hi in both:
                i = lo + np.flatnonzero((no[lo:hi] >= a) & (no[lo:hi] < a + tile))
                j = lo + np.flatnonzero((no[lo:hi] >= b) & (no[lo:hi] < b + tile))
                x, y, at_x, at_y = p[i][:, None], p[j][None, :], base[no[i]][:, None], base[no[j]][None, :]
                out[np.ix_(no[i] - a, no[j] - b)] += np.abs(x - y) - np.abs(x - at_y) - np.abs(at_x - y) + np.abs(at_x - at_y)
            yield a, b, out


def pair_sums(cells: DataFrame, groups: DataFrame, cells_per_bucket: int = CELLS) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    counts = cells.groupBy("lang").agg(F.count("*").alias("__c"))
    numbered = groups.withColumn("__no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    # A language's sources with their baselines: a row a language, as long as the matrix is wide.
    bases = numbered.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("__no", "base"))), lambda x: x["base"]).alias("__bases")).join(counts, "lang")
    rows = cells.join(_small(numbered.select("lang", "source", "__no")), ["lang", "source"]).join(_small(bases.select("lang", "__c")), "lang")
    k = F.pmod(F.xxhash64("term"), F.ceil(F.col("__c") / cells_per_bucket))
    rows = rows.select("lang", k.alias("__k"), "__no", F.xxhash64("term").alias("__h"), "term", "p")

    def run(key: tuple, own: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"lang": [], "__g": [], "__i": [], "__v": []})
        at, out = np.asarray(base["__bases"].iloc[0], dtype=np.int64), []
        term = pd.factorize(own["term"])[0]
        for a, b, m in bucket_sums(own["__no"].to_numpy(np.int64), term, own["p"].to_numpy(np.int64), at):
            i, j = np.nonzero(m)
            i, j, v = i + a, j + b, m[i, j]
            i, j, v = i[i < j], j[i < j], v[i < j]
            out.append(pd.DataFrame({"lang": key[0], "__g": i, "__i": j, "__v": v}))
        return pd.concat(out)

    spread = bases.select("lang", "__bases", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__c") / cells_per_bucket) - 1)).alias("__k"))
    part = rows.groupBy("lang", "__k").cogroup(spread.groupBy("lang", "__k")).applyInPandas(run, "lang string, __g long, __i long, __v long")
    sums = part.groupBy("lang", "__g", "__i").agg(F.sum("__v").alias("__v"))
    both = sums.unionByName(sums.select("lang", F.col("__i").alias("__g"), F.col("__g").alias("__i"), "__v"))
    one = numbered.select("lang", "source", F.col("__no").alias("__g"), "base", "terms")
    two = numbered.select("lang", F.col("source").alias("item"), F.col("__no").alias("__i"), F.col("base").alias("__base"))
    pairs = one.join(two, "lang").where(F.col("__g") != F.col("__i")).join(both, ["lang", "__g", "__i"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return pairs.select("lang", "source", "item", (zero(F.col("terms") * F.abs(F.col("base") - F.col("__base"))) + zero(F.col("__v"))).alias("value"))


def _digits(rows: DataFrame, group: list[str], digit: Column, descending: bool) -> DataFrame:
    """Per group and with `__need` the digit that holds the row asked for, the rows of digits before it, and the rows in it."""
    hist = rows.groupBy(*group, "__need", digit.alias("__d")).agg(F.count("*").alias("__c"))
    order = F.col("__d").desc() if descending else F.col("__d").asc()
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # as many rows as a digit has values
    upto = hist.withColumn("__upto", F.sum("__c").over(w))
    return upto.where((F.col("__upto") >= F.col("__need")) & (F.col("__upto") - F.col("__c") < F.col("__need"))).select(
        *group, "__d", (F.col("__need") - (F.col("__upto") - F.col("__c"))).alias("__need"), F.col("__c").alias("__left")
    )


def radix_top(rows: DataFrame, group: list[str], value: str, item: str, k: int, bits: int, scratch: Scratch) -> DataFrame:
    """The k first rows of each group by value (whole, not negative, below 2 ** bits) descending, then item by its UTF-8 bytes, with
    their rank. Rows have distinct items within a group; groups are told by non-null columns."""
    # Groups of at most k rows are taken whole.
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__c"))
    heads = scratch.keep(sizes.select(*group, F.least(F.lit(k), F.col("__c")).cast("long").alias("__need"), F.lit(0).cast("long").alias("__at")), "heads")
    shift = -(-bits // DIGIT) * DIGIT
    while shift > 0:
        # __at: the bits found so far; only rows that share them are counted.
        shift -= DIGIT
        live = rows.join(_small(heads), group).where(F.shiftrightunsigned(value, shift + DIGIT) == F.col("__at"))
        found = _digits(live, [*group, "__at"], F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)), True)
        heads = scratch.keep(found.select(*group, "__need", (F.col("__at") * (1 << DIGIT) + F.col("__d")).alias("__at")), "heads")
    # Above the threshold: fewer than k rows a group. At it: `__need` rows, by the bytes of the item.
    marked = rows.join(_small(heads), group)
    above = marked.where(F.col(value) > F.col("__at")).drop("__at", "__need")
    ties = marked.where(F.col(value) == F.col("__at")).withColumn("__hex", F.hex(F.encode(item, "UTF-8")))
    ties = scratch.keep(ties.drop("__at"), "ties")
    took, pos = [above], 0
    while True:
        left = ties.groupBy(*group).agg(F.count("*").alias("__c"))
        if not left.where(F.col("__c") > FEW).limit(1).collect():
            break
        # The next byte, as two hex digits; items that end come first.
        byte = F.substring("__hex", 2 * pos + 1, 2)
        found = _small(scratch.keep(_digits(ties, group, byte, False).drop("__left"), "bytes"))
        marked = ties.drop("__need").join(found, group)
        took.append(marked.where(byte < F.col("__d")).select(above.columns))
        ties = scratch.keep(marked.where(byte == F.col("__d")).drop("__d"), "ties")
        pos += 1
    w = Window.partitionBy(*group).orderBy(item)  # at most FEW rows a group
    took.append(ties.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= F.col("__need")).select(above.columns))
    out = took[0]
    for t in took[1:]:
        out = out.unionByName(t)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc(), item)))  # at most k rows a group


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, smooth: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language with the summed difference, part
    `term` the `top` terms that the source uses more than its language does."""
    scratch = Scratch(docs.sparkSession, "divergence")
    cells, groups = shares(counted(docs, lang, source, text), scratch, min_docs, smooth, scale)
    pairs = pair_sums(cells, groups)
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")  # a row a source of the language
    pairs = pairs.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    over = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = radix_top(over, ["lang", "source"], "value", "item", top, int(scale + 1).bit_length(), scratch).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms in 30 documents or more of their language, ranks of terms up to 50."""
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(any_value(l.v), 0) AS v, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
