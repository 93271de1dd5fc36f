"""Near copies: SimHash candidates through the Gray-order index, made whole by a prefix-filter join, all verified exactly.

A link is a Jaccard similarity of `similarity` or more between two texts' sets of word shingles. At 0.8 the 64-bit codes of two
texts differ in about ten bits, which no index of codes finds without comparing nearly all: the codes find the closest copies,
and the join on shingles finds every other link. The stage of the corpus pipeline uses it.

1. A text's set are the XXH64 values of its word shingles; texts with equal sets are one node. All comparisons are of sets.
2. Candidates by SimHash: nodes with codes of `radius` or fewer differing bits (`simhash.linked_codes`).
3. Candidates by shingles: sets of similarity s or more share one of the first n - ceil(s * n) + 1 of their n shingles, in any
   order that is the same for all texts. So every linked pair meets in a bucket (a shingle with the nodes that have it among
   their first). The order decides only how large buckets are: shingles that are common in a sample of the texts come late,
   and those whose buckets turn out to have more than `MANY` nodes come last, the larger the later: so texts are found by what
   few others have, and a phrase that more texts have as the corpus grows makes no more pairs.
4. Two nodes' counts of shingles by `PARTS` parts of the hash bound their common shingles from above; pairs that cannot
   reach s by this bound need no look at their sets.
5. The SimHash candidates and all pairs of buckets with up to `few` nodes are verified. Larger buckets are searched in `rounds`
   rounds: every node is verified against one node of each of its buckets, links become components, and buckets within one
   component are done. That node is drawn anew for each of `HEADS` kinds of shingle, so that in a group of near copies, whose
   buckets hold much the same nodes, each is compared with about as many others, and few stay apart. The pairs across components that are left come from `unsettled`. A group of near copies so takes about
   as many pairs as it has nodes, and texts with one passage in common take none.
6. Sets of n and m shingles that are a link have s * (n + m) / (1 + s) in common, so the first of those is at place
   i <= (n - s * m) / (1 + s) of the one and likewise of the other. A node at place i of a bucket so meets no partner first there
   that has more than (n - (1 + s) * i) / s shingles, and the smaller of the two is at place n * (1 - s) / (1 + s) at most. In
   buckets of more than `wide` nodes only the nodes stay for which another component has a partner small enough: texts with a
   common template or near copies with many words of their own, which can't be links by it, make no pairs.

   Of their pairs those are left out, too, whose sets differ in more values than a link may by the parities of their counts by
   parts: sets of s * (n + m) / (1 + s) common values differ in (1 - s) * (n + m) / (1 + s) at most.

Texts without a word are copies of each other only. Rows with a null id take no part in links. Joins whose keys may be hot have
an aggregate with one row a key on the other side, so that adaptive execution can split them. Rows that a bitmap tells from all
keys (texts that stay, texts without copies) are not shuffled to meet them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._common import Scratch, arrow, hash_unit
from .simhash import codes_of, components, linked_codes, shingles

SLOTS = 1 << 22
MOST_SLOTS = 28  # a power of two
PARTS = 128
LISTED = 1 << 18
LATE = 1 << 20
MANY = 8
HEADS = 8
ODD = [f"odd{k}" for k in range(PARTS // 32)]


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, text of each, node of each text, SimHash code of each text): the set of each text, ordered by text and value."""
    h, n = shingles(data, off, size)
    code = codes_of(h, n)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    edge = np.searchsorted(doc, np.arange(len(n) + 1))
    node = T.mix(T.reduce_sum(T.mix(h), edge[:-1], edge[1:]) + np.diff(edge).astype(np.uint64))
    return h, doc, node.view(np.int64), code


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    off = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _digest(text_col).alias("digest"))
    return src.where("doc_id is not null")


Late = tuple[np.ndarray, np.ndarray]  # shingles, and how many texts have each


def common_shingles(src: DataFrame, size: int, sample: int = 20_000, least: int = 8) -> Late:
    """Values that `least` of about `sample` texts have, `LISTED` at most, and about how many of all texts have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, off in T.slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(data, off, size)[0].view(np.int64))], names=["tok"])

    share = min(1.0, sample / max(src.count(), 1))
    drawn = src.where(hash_unit(F.col("doc_id"), F.lit("near copies")) < share)
    found = arrow(drawn.select("doc_id", "text"), run, "tok long").groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    tok, n = _columns(found.orderBy(F.desc("n"), "tok").limit(LISTED))
    return tok, (n / share).astype(np.int64)


def _columns(df: DataFrame) -> Late:
    got = df.toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


def merged(a: Late, b: Late) -> Late:
    """The shingles of both, with the larger number of those in both."""
    tok, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    n = np.zeros(len(tok), np.int64)
    np.maximum.at(n, at, np.concatenate((a[1], b[1])))
    return tok, n


class Order:
    """The late shingles: values, sorted, and the place of each by how many texts have it. All others have place 0."""

    def __init__(self, late: dict[int, int] | Late):
        tok, n = (np.array(list(x), dtype=np.int64) for x in (late.keys(), late.values())) if isinstance(late, dict) else late
        by = np.argsort(tok)
        self.tok, n = tok[by], n[by]
        self.place = np.zeros(len(n), np.int32)
        self.place[np.argsort(n, kind="stable")] = np.arange(1, len(n) + 1)

    def places(self, h: np.ndarray) -> np.ndarray:
        if not len(self.tok):
            return np.zeros(len(h), np.int64)
        h = h.view(np.int64)
        at = np.minimum(np.searchsorted(self.tok, h), len(self.tok) - 1)
        return np.where(self.tok[at] == h, self.place[at], 0)


def outlines(src: DataFrame, order: Order, size: int, share: Fraction) -> DataFrame:
    """(doc_id, digest, node, code, n, parts, prefix, odd); `parts` has a byte for each part of the hash, 255 for that many or more,
    and odd the parities of the counts by twice as many parts, a bit each."""
    held = src.sparkSession.sparkContext.broadcast(order)  # LISTED shingles and LATE for each round at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, off in T.slices(b.column(1)):
                h, doc, node, code = shingle_sets(data, off, size)
                n = np.bincount(doc, minlength=end - first)
                part = np.bincount(doc * 2 * PARTS + (h % np.uint64(2 * PARTS)).astype(np.int64), minlength=2 * PARTS * (end - first))
                odd = np.packbits(part.reshape(-1, 2 * PARTS) & 1, axis=1).view(np.int64)
                part = part.reshape(-1, 2, PARTS).sum(1)
                parts = [x.tobytes() for x in np.minimum(part, 255).astype(np.uint8)]
                order = np.lexsort((h, held.value.places(h), doc))
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                on = rank < np.repeat(n + n * -share.numerator // share.denominator + 1, n)  # n - ceil(share * n) + 1
                own = b.slice(first, end - first)
                cols = [own.column(0), own.column(2), pa.array(node), pa.array(code.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(parts, pa.binary()), _lists(h[order][on], doc[on], end - first), *map(pa.array, odd.T)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "node", "code", "n", "parts", "prefix", *ODD])

    return arrow(src, run, "doc_id long, digest binary, node long, code long, n int, parts binary, prefix array<long>" + "".join(f", {x} long" for x in ODD))


def apart(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key surely is none of `keys` (one column), and the others: told by a bitmap of hashes with at least eight
    slots a key, `MOST_SLOTS` at most. The first have no need to meet the keys, so they aren't shuffled."""
    slots = 1 << min(MOST_SLOTS, max(16, (8 * keys.count()).bit_length()))
    word = lambda c: F.floor(F.pmod(F.xxhash64(c), F.lit(slots)) / 64).cast("int")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(64)).cast("int")
    one = F.col(f"`{keys.columns[0]}`")
    got = keys.select(word(one).alias("word"), bit(one).alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    words = np.zeros(slots // 64, np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    held = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"words": [words]})))
    hit = F.getbit(F.get(held["words"], word(key)), bit(key)) == 1
    return rows.join(held, hit, "left_anti"), rows.join(held, hit, "left_semi")


def _slot(col: str) -> Column:
    return F.pmod(F.col(col), F.lit(SLOTS)).cast("int")


def sets_of(src: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, vals) of the given nodes. Texts whose node falls in no slot of a given one are left out before the join."""
    taken = np.zeros(SLOTS, dtype=bool)
    taken[nodes.select(_slot("node").alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    held = src.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = np.unpackbits(held.value).astype(bool)
        for b in batches:
            for first, end, data, off in T.slices(b.column(1)):
                h, doc, node, _ = shingle_sets(data, off, size)
                _, one = np.unique(node, return_index=True)
                keep = np.zeros(len(node), dtype=bool)
                keep[one] = True
                keep &= taken[node % SLOTS]
                yield pa.RecordBatch.from_arrays([pa.array(node), _lists(h, doc, end - first)], names=["node", "vals"]).filter(pa.array(keep))

    return arrow(src.select("doc_id", "text"), run, "node long, vals array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def possible(pairs: DataFrame, parts: DataFrame, share: Fraction) -> DataFrame:
    """The distinct (u, v), u > v, of pairs (u, v) that may be links by their sizes and parts."""
    p, q = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(T.buffers(b.column(k))[0], np.uint8).reshape(-1, PARTS) for k in (2, 3))
            n = x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64)
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            keep = (most * q >= (n - most) * p) | (x == 255).any(1) | (y == 255).any(1)
            yield b.select(["u", "v"]).filter(pa.array(keep))

    near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    both = near.join(parts.toDF("u", "x"), "u").join(parts.toDF("v", "y"), "v").select("u", "v", "x", "y")
    return arrow(both, run, "u long, v long")


def unsettled(now: DataFrame, share: Fraction, wide: int, odd: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) across components that may be links, of the rows (tok, node, n, i, m, c) of buckets: i is the place of the
    shingle tok among the node's first, m the bucket's size, c the node's component.

    Pairs of buckets with up to `wide` nodes are counted: those that share as many of their first as a link does, one in a wide
    bucket taken as shared, and that meet early enough stay. Pairs of wide buckets only have to meet early enough. With `odd`
    (node and `ODD`) only pairs are made whose parities leave a link open: two sets differ in as many values at least."""
    p, q = share.numerator, share.denominator
    near = f"least(n, nv) * {q}L >= greatest(n, nv) * {p}L"  # so sizes fall into one class or two that follow
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(q / p) + 1e-9).cast("int")
    most = F.floor((F.col("n") * F.lit(q).cast("long") - F.col("i") * F.lit(p + q).cast("long")) / p).cast("long")  # of a partner's size
    bits, alike = [] if odd is None else ODD, "true"
    if odd is not None:
        now = now.join(odd, "node")
        alike = f"({' + '.join(f'bit_count({x} ^ {x}v)' for x in ODD)}) * {q + p}L <= (n + nv) * {q - p}L"
    now = now.select("tok", "node", "n", "m", "c", step.alias("at"), most.alias("most"), *bits)

    def other(rows: DataFrame) -> DataFrame:
        names = {"node": "v", "n": "nv", "c": "cv", "most": "mv", "at": "av", "h": "hv"} | {x: f"{x}v" for x in bits}
        at = F.explode(F.array("at", F.col("at") - 1)).alias("at")
        return rows.select("tok", at, *(F.col(x).alias(y) for x, y in names.items() if x in rows.columns))

    in_wide = now.where(F.col("m") > wide)
    held = in_wide.groupBy("node").agg(F.count("*").alias("h"))
    mine = now.where(F.col("m") <= wide).join(held, "node", "left").fillna(0, ["h"])
    pairs = mine.join(other(mine), ["tok", "at"]).where(f"c <> cv and {near} and (av > at or node > v) and {alike}")
    need = f"(n * {p}L + nv * {p}L + {p + q - 1}L) div {p + q} - (greatest(n, nv) * {p}L + {q - 1}L) div {q} + 1"
    counted = pairs.groupBy(F.col("node").alias("u"), "v", "n", "nv", "h", "hv").agg(F.count("*").alias("k"), F.max("most").alias("most"), F.max("mv").alias("mv"))
    counted = counted.where(f"nv <= most and n <= mv and k + least(h, hv) >= {need}").select("u", "v")

    around = in_wide.select("tok", "c", "n", F.explode(F.array(*(F.col("at") + k for k in (-1, 0, 1)))).alias("at"))
    least = around.groupBy("tok", "at", "c").agg(F.min("n").alias("low"))
    first = least.groupBy("tok", "at").agg(F.min(F.struct("low", "c")).alias("first"))
    second = least.join(first, ["tok", "at"]).where("c <> first.c").groupBy("tok", "at").agg(F.min("low").alias("second"))
    bound = first.join(second, ["tok", "at"]).select("tok", "at", F.col("first.c").alias("fc"), F.col("first.low").alias("first"), "second")
    able = in_wide.join(bound, ["tok", "at"]).where("if(c = fc, second, first) <= most").drop("fc", "first", "second")
    early = able.where("n <= most").join(other(able), ["tok", "at"])
    early = early.where(f"c <> cv and {near} and nv <= most and n <= mv and (nv > n or nv = n and node > v) and {alike}").select(F.col("node").alias("u"), "v")
    return counted.unionByName(early)


def linked(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 2, rounds: int = 2, few: int = 2, wide: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, component_id, node, digest) of each row with an id: component_id is the smallest id reachable over links of
    `similarity` or more, digest the SHA-256 of the text."""
    share, spark = Fraction(str(similarity)), docs.sparkSession
    p, q = share.numerator, share.denominator
    scratch, src = Scratch(spark, "copies"), _source(docs, id_col, text_col)
    late = common_shingles(src, size)
    scratch.sweep()
    for k in range(3):  # the first order, and two in which the shingles of large buckets come last
        fps = scratch.keep(outlines(src, Order(late), size, share), "outlines")
        twice = scratch.keep(fps.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select("node"), "twice")
        once, more = apart(fps.select("node", "n", "code", "parts", "prefix", *ODD), F.col("node"), twice)
        nodes = scratch.keep(once.union(more.dropDuplicates(["node"])), "nodes")
        own = scratch.keep(fps.select("doc_id", "node", "digest"), "own")
        scratch.drop(fps)
        del fps, once, more
        scratch.sweep()
        met = nodes.select("node", "n", F.posexplode("prefix").alias("i", "tok"))
        shared = met.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1")  # a node has a shingle once
        shared = scratch.keep(shared, "shared")
        total = shared.agg(F.sum("m")).first()[0] or 0
        hot = _columns(shared.where(F.col("m") > max(MANY, total // LATE))) if k < 2 else late  # LATE shingles at most are larger
        new = hot[1][~np.isin(hot[0], late[0])]
        if new @ new <= total:  # their pairs are fewer than the buckets' rows
            break
        late = merged(late, hot)
        del hot, new
        scratch.sweep()
        for t in (nodes, own, shared):
            scratch.drop(t)
    scratch.sweep()
    rows = scratch.keep(met.join(shared, "tok"), "buckets")
    scratch.drop(shared)
    scratch.sweep()
    parts = scratch.keep(nodes.select("node", "parts", *ODD).join(rows.select("node").distinct(), "node", "left_semi"), "parts")
    parts, odd = parts.select("node", "parts"), parts.select("node", *ODD)
    small, large = rows.where(F.col("m") <= few), rows.where(F.col("m") > few)
    near = f"least(n, nv) * {q}L >= greatest(n, nv) * {p}L"  # sizes
    other = small.select("tok", F.col("node").alias("v"), F.col("n").alias("nv"))
    pairs = small.join(other, "tok").where(f"node > v and {near}").select(F.col("node").alias("u"), "v")
    by_code = nodes.groupBy(F.col("code").alias("fp")).agg(F.min("node").alias("rep"))
    by_code = scratch.keep(by_code, "codes")
    alike = nodes.join(by_code, F.col("code") == F.col("fp")).where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    alike = alike.unionByName(linked_codes(by_code, scratch, radius))
    state = {"edges": spark.createDataFrame([], "u long, v long")}

    def link(pairs: DataFrame) -> None:
        """Verifies pairs (u, v) and takes the links in. Only sets of texts in a pair are read again from the texts."""
        some = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets = scratch.keep(sets_of(src, scratch.keep(some, "some"), size), "sets")
        a, b = sets.toDF("u", "x"), sets.toDF("v", "y")
        both = pairs.join(a, "u").join(b, "v").select("u", "v", (F.size("x") + F.size("y")).alias("s"), F.size(F.array_intersect("x", "y")).alias("k"))
        state["edges"] = state["edges"].unionByName(scratch.keep(both.where(f"k * {q}L >= (s - k) * {p}L").select("u", "v"), "links"))
        scratch.drop(sets)
        del sets, a, b, both, some
        scratch.sweep()
        state["comp"] = scratch.keep(components(state["edges"], scratch), "components")

    def live() -> DataFrame:
        """The rows of large buckets with several components."""
        now = large.join(state["comp"], "node", "left").select("tok", "node", "n", "i", "m", F.coalesce("component", "node").alias("c"))
        left = now.groupBy("tok").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("tok")
        return scratch.keep(now.join(left, "tok", "left_semi"), "live")

    pairs = scratch.keep(possible(pairs.unionByName(alike), parts, share), "pairs")
    scratch.drop(nodes)
    del nodes, met, shared, alike, by_code, small, other
    scratch.sweep()
    link(pairs)
    for r in range(rounds + 1):
        now = live()
        if now.isEmpty():
            break
        if r < rounds:
            key = F.struct(F.xxhash64("node", F.lit(r), F.pmod("tok", F.lit(HEADS))).alias("h"), F.col("node").alias("v"), F.col("n").alias("nv"), F.col("c").alias("cv"))
            heads = now.groupBy("tok").agg(F.min(key).alias("head")).select("tok", "head.v", "head.nv", "head.cv")
            pairs = now.join(heads, "tok")
            pairs = pairs.where(f"c <> cv and {near}").select(F.col("node").alias("u"), "v")
        else:
            pairs = unsettled(now, share, wide, odd)
        link(scratch.keep(possible(pairs, parts, share), "pairs"))
    ids = own.groupBy("node").agg(F.min("doc_id").alias("low"))
    ids = scratch.keep(ids.join(state["comp"], "node", "left").select("node", "low", F.coalesce("component", "node").alias("c")), "ids")
    reach = ids.join(ids.groupBy("c").agg(F.min("low").alias("component_id")), "c").select("node", "component_id")
    return own.join(reach, "node").select("doc_id", "component_id", "node", "digest")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without those that another row stands for. Of each component one row stays: the one with the smallest
    id, among rows of that id the one whose text has the smallest SHA-256, among rows of that text, too, the one whose other
    columns come first in the order of their JSON. Rows are told by id and text, so rows of one id with other texts stay.
    Rows with a null id stay."""
    scratch = Scratch(docs.sparkSession, "kept")
    own = {c.lower() for c in docs.columns}
    an_id, a_digest, a_row = (next(x for k in range(len(own) + 1) if (x := f"__{name}{k}") not in own) for name in ("id", "digest", "row"))
    found = scratch.keep(linked(docs, size, similarity, id_col=id_col, text_col=text_col), "linked")
    rows = found.groupBy("component_id", "doc_id", "digest").agg(F.count("*").alias("rows"))
    kept = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "rows")).alias("k")).select("k.*")
    key = [F.col("doc_id").alias(an_id), F.col("digest").alias(a_digest)]
    out = scratch.keep(rows.join(kept, ["doc_id", "digest"], "left_anti").select(*key), "out")
    again = scratch.keep(kept.where("rows > 1").select(*key), "again")
    on = (F.col(id_col).cast("long") == F.col(an_id)) & (_digest(text_col) == F.col(a_digest))
    stays, rest = apart(docs, F.col(id_col).cast("long"), out.select(an_id))
    left = stays.union(rest.join(out, on, "left_anti"))
    if again.isEmpty():
        return left
    same = docs.join(again, on, "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = same.groupBy(F.col(id_col).alias(an_id), _digest(text_col).alias(a_digest)).agg(F.min_by(whole, F.to_json(whole)).alias(a_row)).select(f"{a_row}.*")
    return left.join(again, on, "left_anti").unionByName(one)
