"""SimHash near-duplicates with a Gray-order hierarchical index.

1. `fingerprints`: 64 bits per text from the XXH64 values of its word shingles.
2. `linked_codes`: codes at a Hamming distance of `radius` or less. Equal codes are merged first. The distinct ones are
   dealt by bit blocks (radius + 1 disjoint blocks: two linked codes agree in one of them at least, so no link is lost). A
   block value that more than `bucket` codes share is dealt again by blocks of its free bits, and so on; with r free bits
   left a bucket holds 2^r codes at most, which bounds every bucket without dropping a code.
   Within a bucket the codes are sorted by Gray rank and packed, eight by eight, under nodes that hold the bits all their
   codes share. A search walks down with the differences it has met so far and leaves a whole group as soon as they
   exceed the radius. A bucket gives a spanning forest of its links, never all pairs.
3. `components`: alternating large-star and small-star rounds over the forests' edges, each round a written table.

Empty and null texts, and texts without a word, have the code zero and link like any other code. Repeated rows keep their
rows; a null id stays in the result with its code and takes part by the component of its code (null if no id has it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import Scratch, arrow, table

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    # The primes of XXH64.
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:start + length] for each span; spans of one length are hashed together."""
    out = np.empty(len(start), dtype=np.uint64)
    if not len(start):
        return out
    pad = np.concatenate((data, np.zeros(8, np.uint8)))
    w8 = np.ndarray((len(pad) - 7,), dtype="<u8", buffer=pad, strides=(1,))
    w4 = np.ndarray((len(pad) - 7,), dtype="<u4", buffer=pad, strides=(1,))
    order = np.argsort(length.astype(np.uint16) if length.max() < 65536 else length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    seed = np.uint64(seed)
    for k, n in enumerate(sizes.tolist()):
        at = order[first[k] : first[k + 1] if k + 1 < len(first) else None]
        s, pos = start[at], 0
        if n >= 32:
            v = [np.full(len(at), seed, dtype=np.uint64) for _ in range(4)]
            v = [v[0] + _P1 + _P2, v[1] + _P2, v[2], v[3] - _P1]
            while pos + 32 <= n:
                v = [_round(v[j], w8[s + pos + 8 * j]) for j in range(4)]
                pos += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        else:
            h = np.full(len(at), seed, dtype=np.uint64) + _P5
        h = h + np.uint64(n)
        while pos + 8 <= n:
            h = _rotl(h ^ (_rotl(w8[s + pos] * _P2, 31) * _P1), 27) * _P1 + _P4
            pos += 8
        if pos + 4 <= n:
            h = _rotl(h ^ (w4[s + pos].astype(np.uint64) * _P1), 23) * _P2 + _P3
            pos += 4
        while pos < n:
            h = _rotl(h ^ (pad[s + pos].astype(np.uint64) * _P5), 11) * _P1
            pos += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        out[at] = h
    return out


def words_one_space(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, first, end word): the texts with A-Z lowered and one space between words, the words' spans in
    those bytes, and each text's range of words."""
    data, off = T.spaced(T.LOWER[data] if len(data) else data, off)
    word = ~T.BLANK[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first blank after a word
    out = np.where(word, data, np.uint8(32))[keep]
    start, end = T.runs(out != 32)
    at = np.concatenate(([0], np.cumsum(keep)))[off]
    return out, start, end, np.searchsorted(start, at[:-1]), np.searchsorted(start, at[1:])


def shingles(data: np.ndarray, off: np.ndarray, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of each text) of the word shingles, repeats included; a shorter text is one shingle."""
    out, ws, we, lo, hi = words_one_space(data, off)
    n_words = hi - lo
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    first = T.ranges(lo, n)
    last = first + np.repeat(np.where(n_words >= size, size - 1, n_words - 1), n)
    s = ws[first]
    return xxh64_spans(out, s, we[last] - s, seed), n


def codes_of(h: np.ndarray, n_sh: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from its shingles' hashes."""
    # Counts of bits: eight planes with a byte for each bit, summed over 255 shingles at most, then over the text.
    blocks = -(-n_sh // 255)
    sh_at = np.cumsum(n_sh) - n_sh
    b_start = np.repeat(sh_at, blocks) + 255 * T.ranges(np.zeros(len(blocks), np.int64), blocks)
    b_at = np.cumsum(blocks) - blocks
    code = np.zeros(len(n_sh), dtype=np.uint64)
    if not len(h):
        return code
    for k in range(8):
        plane = (h >> np.uint64(k)) & np.uint64(0x0101010101010101)
        part = np.add.reduceat(plane, b_start).view(np.uint8).reshape(-1, 8)
        count = T.reduce_sum(part, b_at, b_at + blocks, np.int64)
        for j in range(8):
            code |= (2 * count[:, j] > n_sh).astype(np.uint64) << np.uint64(8 * j + k)
    return code


def codes(data: np.ndarray, off: np.ndarray, size: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text."""
    return codes_of(*shingles(data, off, size, seed))


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the code as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [codes(d, o, size, seed) for _, _, d, o in T.slices(b.column(1))]
            fp = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow(src, run, "doc_id long, fp long")


# --- the index -------------------------------------------------------------------------------------------------------


def gray_rank(code: np.ndarray) -> np.ndarray:
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Codes of many buckets, sorted by (bucket, Gray rank). levels[0] are the codes; a node above has the bits its
    children share (`mask`) and their values (`pat`), where bits that its own parent holds are taken out again, so that the
    differences met on the way down add up to the distance."""

    def __init__(self, code: np.ndarray, bucket: np.ndarray, fan: int = 8):
        self.order = np.lexsort((gray_rank(code), bucket))
        self.code, self.bucket = code[self.order], bucket[self.order]
        n, full = len(code), np.uint64((1 << 64) - 1)
        pat, mask, owner = self.code, np.full(n, full), self.bucket
        levels = [[pat, mask, None, None]]
        while True:
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.concatenate((head, [len(owner)])))
            if (size == 1).all():
                break
            nodes = -(-size // fan)
            first = np.repeat(head, nodes) + fan * T.ranges(np.zeros(len(nodes), np.int64), nodes)
            end = np.minimum(first + fan, np.repeat(head + size, nodes))
            ones = np.bitwise_and.reduceat(pat | ~mask, first)
            some = np.bitwise_or.reduceat(pat & mask, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(some ^ ones)
            levels.append([some & shared, shared, first, end - first])
            pat, mask, owner = some & shared, shared, owner[first]
        self.roots = np.searchsorted(owner, self.bucket)
        for low, up in zip(levels, levels[1:], strict=False):
            low.append(low[1] & ~np.repeat(up[1], up[3]))  # what the parent doesn't hold
        levels[-1].append(levels[-1][1])
        self.levels = levels

    def pairs(self, radius: int, block: int = 1 << 13, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of linked codes, a block of queries at a time. A search that has over `most` nodes open is
        halved, so memory is bounded whatever the codes."""
        top = len(self.levels) - 1
        for lo in range(0, len(self.code), block):
            q = np.arange(lo, min(lo + block, len(self.code)))
            open_ = [(top, q, self.roots[q], np.zeros(len(q), np.int64))]
            while open_:
                k, q, node, acc = open_.pop()
                if len(q) > most:
                    half = len(q) // 2
                    open_ += [(k, q[half:], node[half:], acc[half:]), (k, q[:half], node[:half], acc[:half])]
                    continue
                pat, _, first, count, own = self.levels[k]
                acc = acc + np.bitwise_count((self.code[q] ^ pat[node]) & own[node])
                on = acc <= radius
                q, node, acc = q[on], node[on], acc[on]
                if k:
                    c = count[node]
                    open_.append((k - 1, np.repeat(q, c), T.ranges(first[node], c), np.repeat(acc, c)))
                    continue
                on = q < node
                yield q[on], node[on]


def forest(code: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (input positions) that connect just what the links within each bucket connect."""
    index = GrayIndex(code, bucket)
    label = np.arange(len(code))
    for i, j in index.pairs(radius):
        while True:
            a, b = label[i], label[j]
            on = a != b
            if not on.any():
                break
            i, j, a, b = i[on], j[on], a[on], b[on]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    at = np.flatnonzero(label != np.arange(len(code)))
    return index.order[at], index.order[label[at]]


def _split(mask: int, parts: int) -> list[int]:
    """Masks of `mask` and one more of `parts` blocks of its free bits, from the highest bit on."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    out, at = [], 0
    for k in range(parts):
        n = (len(free) - at) // (parts - k)
        out.append(mask | sum(1 << b for b in free[at : at + n]))
        at += n
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_codes(reps: DataFrame, scratch: Scratch, radius: int = 2, bucket: int = 4096) -> DataFrame:
    """Edges (u, v), u > v, between representatives (fp, rep) of distinct codes; they connect what links connect."""
    parts, bucket = radius + 1, max(bucket, 64)
    masks = _split(0, parts)
    keyed = reps.select("fp", "rep", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    done = None
    while True:  # ends: with r free bits no bucket has over 2^r codes
        keyed = keyed.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        hot = keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        hot = scratch.keep(hot.select("mask", "part"), "hot")
        last = hot.isEmpty()
        cold = keyed if last else keyed.join(hot, ["mask", "part"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        if last:
            break
        below = [(m, c) for m in masks for c in _split(m, parts) if c != m]
        tree = reps.sparkSession.createDataFrame([(_signed(m), _signed(c)) for m, c in below], "mask long, next long")
        keyed = keyed.join(hot, ["mask", "part"], "left_semi").join(F.broadcast(tree), "mask").select("fp", "rep", F.col("next").alias("mask"))
        keyed = scratch.keep(keyed, "keyed")  # the next level starts here
        masks = [c for _, c in below]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def edges(cols: list[np.ndarray]):
            part, mask, fp, rep = cols
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (mask[1:] != mask[:-1])))
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            fp, rep, group = fp[many], rep[many], group[many]
            if len(fp):
                a, b = forest(fp.view(np.uint64), group, radius)
                u, v = np.maximum(rep[a], rep[b]), np.minimum(rep[a], rep[b])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = [np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True)] if rest else cols
            n = len(cols[0])
            if n < 30_000:
                rest = cols
                continue
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut:
                yield from edges([c[:cut] for c in cols])
            rest = [c[cut:] for c in cols]
        if rest and len(rest[0]):
            yield from edges(rest)

    dealt = done.select("part", "mask", "fp", "rep").repartition("part", "mask").sortWithinPartitions("mask", "part")
    return arrow(dealt, run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """(node, component) of all nodes with an edge: the smallest node reachable. Large-star and small-star rounds."""
    edges = scratch.keep(edges.where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = scratch.keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "round")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # A star by now: every node has one edge, to the smallest of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, seed: int = 42, bucket: int = 4096) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over
    links of `radius` or fewer differing bits, itself included)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, size, seed), "fingerprints")
    reps = scratch.keep(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "codes")
    comp = components(linked_codes(reps, scratch, radius, bucket), scratch)
    reach = reps.join(comp, reps["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(reach, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
