"""Main text of web pages: block extraction and nearest-URL page differencing.

1. A page is read once, token by token, into its text lines (blocks) in page order. Each line has a zone: inside an article
   or main element, elsewhere in the body, or furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments,
   by element, role or name). An article or main element within furniture by name or form counts as outside it, as wrappers
   of whole pages have such names; not so within menus, headers, footers, sidebars and comments. Within an article elements and
   roles decide as elsewhere, but names don't, as "related-work" and "share-price" name content, too: beyond the plain names of
   adverts and comments (`_ADVERTS`, `_REPLIES`) a line under a name of furniture is in doubt. Scripts, styles, other raw elements
   and markup comments give no line.
2. Pages are put in the order of (host, path, id) over the whole table and numbered; each page is paired with the next one of
   its host, so with both its nearest URLs. Numbering goes by sorted ranges and their row counts, and pairing by the number, so
   that a host with a third of all pages is dealt as evenly as any other.
3. All lines of a pair are aligned by longest common subsequence, those of articles and furniture, too; a line aligned with either
   neighbour is shared.
4. Lines of an article or main element are protected but for those in doubt: copies of an article under two URLs of a host share
   all their lines, and deleting those would lose the text. A shared line is common furniture where neither page protects it:
   such lines in doubt and such body lines are deleted. A page with an article is its protected lines and what is left of those
   in doubt; one without is what is left of its body lines, or all of them where none is left (a copy of its neighbour). Furniture never counts.

Null and empty pages have an empty text. Pages without a host are not paired. Repeated rows (same id, url and
page) count once in the order and are extracted row by row.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, arrow, table
from .url_rules import split_url

FURNITURE, BODY, ARTICLE, DOUBT = 0, 1, 2, 3
#: Bytes of a line's outline: its digest and a flag.
LINE = 12
_SURE, _LOOSE = b"\x01", b"\x00"
#: Within page_lines: furniture that an article or main element cannot leave. Its lines are FURNITURE.
CLOSED = -1

#: Their content is text up to their end tag, or else up to the page's end; that of the second ones only where the end tag is there.
_RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
_PAIRED = "noscript|svg|template"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<pair>{_PAIRED})(?=[\s/>])(?:[^>]*[^>/])?>.*?</(?P=pair)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
#: One attribute: its name and its value, if it has one. Values are read as such, so that nothing in them is taken for a name.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = re.compile(r"class|id|role|hidden", re.I)
_NAME = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_OUT = frozenset("nav header footer aside form button select option dialog menu head".split())
_NAMES_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice"
    " newsletter subscribe subscription signup popup modal overlay share sharing social related recommended breadcrumb breadcrumbs comment comments disqus"
    " respond reply replies sidebar widget menu nav navbar navigation footer masthead pagination pager toolbar login search copyright".split()
)
_ROLES_OUT = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


#: Names of what really is a menu, footer, sidebar or list of comments: as the only class or id; comments as any class or id.
_NAMES_CLOSED = frozenset("nav navbar navigation menu footer sidebar breadcrumb breadcrumbs".split())
_COMMENTS = re.compile(r"(?:comments?|disqus|respond|reply|replies)(?![a-z0-9])(?!.*[-_](?:open|opened|closed|enabled|disabled|on|off)$)")


#: Within an article: whole class names of adverts, which differ from page to page, and whole class names or ids of comments.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertisements adsbygoogle".split())
_REPLIES = frozenset("comment comments commentlist comment-list comments-area comments-section disqus_thread".split())


def _out(tag: str, attrs: str, inside: bool) -> int | None:
    """FURNITURE or CLOSED where the element starts furniture, DOUBT where only its name says so within an article."""
    if tag in _OUT and tag != "form":
        return CLOSED
    found = FURNITURE if tag == "form" else None
    if not attrs or tag in ("article", "main", "body", "html") or not _READ.search(attrs):
        return found
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower().strip()
        if key == "hidden":
            return CLOSED
        if key == "role":
            if value in _ROLES_OUT:
                if value not in ("form", "search"):
                    return CLOSED
                found = FURNITURE
        elif key in ("class", "id"):
            names = value.split()
            if inside:
                if not _REPLIES.isdisjoint(names):
                    return CLOSED
                if key == "class" and not _ADVERTS.isdisjoint(names):
                    found = FURNITURE
                elif found is None and not _NAMES_OUT.isdisjoint(_NAME.findall(value)):
                    found = DOUBT
            elif not _NAMES_OUT.isdisjoint(_NAME.findall(value)):
                if value in _NAMES_CLOSED or any(_COMMENTS.match(x) for x in names):
                    return CLOSED
                found = FURNITURE
    return found


def page_lines(page: str | None) -> tuple[list[str], list[int]]:
    """(lines, zones) of a page."""
    lines: list[str] = []
    zones: list[int] = []
    if not page:
        return lines, zones
    stack: list[tuple[str, int]] = []  # element and the zone of its content
    zone, parts, at = BODY, [], 0

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append(text)
            zones.append(max(zone, FURNITURE))

    def pop(k: int) -> None:
        nonlocal zone
        del stack[k:]
        zone = stack[-1][1] if stack else BODY

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(html.unescape(raw) if "&" in raw else raw)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if not inline or (k is not None and stack[k][1] != (stack[k - 1][1] if k else BODY)):
                close()
            if k is not None:
                pop(k)
            continue
        attrs = m["attrs"]
        out = _out(tag, attrs, zone in (ARTICLE, DOUBT)) if attrs or tag in _OUT else None
        if not inline or out is not None:
            close()
        if not inline:  # a block ends an open paragraph; an item ends the item before
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or (stack[k][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    pop(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        if tag in _VOID or attrs.endswith("/") and inline:
            continue
        if zone == CLOSED or out == CLOSED:
            new = CLOSED
        elif tag in ("article", "main"):
            new = ARTICLE
        else:
            new = out if out is not None else zone
        stack.append((tag, new))
        zone = new
    if at < len(page):
        raw = page[at:]
        parts.append(html.unescape(raw) if "&" in raw else raw)
    close()
    return lines, zones


def aligned(a: list, b: list) -> tuple[list[int], list[int]]:
    """Positions in a and in b of a longest common subsequence. Bit-parallel: a row is one integer with a bit a line; memory
    grows with the lines' number to the power of 1.5."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
    pa_, pb = list(range(lo)), list(range(lo))
    x, y = a[lo:ea], b[lo:eb]
    common = set(x) & set(y)
    if common:
        ix, iy = [i for i, v in enumerate(x) if v in common], [j for j, v in enumerate(y) if v in common]
        at: dict[int, int] = {}
        for j, p in enumerate(iy):
            at[y[p]] = at.get(y[p], 0) | 1 << j
        full, n = (1 << len(iy)) - 1, len(ix)
        step = max(1, math.isqrt(n))  # every step-th row is kept, the others are made again on the way back

        def after(v: int, p: int) -> int:
            u = v & at[x[p]]
            return ((v + u) | (v - u)) & full

        kept, v = [full], full
        for k, p in enumerate(ix, 1):
            v = after(v, p)
            if k % step == 0:
                kept.append(v)
        # Bit j of a row is 0 where the length grows at j. Walk back from the end.
        i, j, got, first, rows = n, len(iy), [], n + 1, []
        while i and j:
            if i - 1 < first:
                first = (i - 1) // step * step
                rows = [kept[first // step]]
                for k in range(first, i):
                    rows.append(after(rows[-1], ix[k]))
            if rows[i - first] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1 - first] >> (j - 1) & 1:
                i -= 1
            else:
                got.append((ix[i - 1], iy[j - 1]))
                i, j = i - 1, j - 1
        for p, q in reversed(got):
            pa_.append(lo + p)
            pb.append(lo + q)
    return pa_ + list(range(ea, len(a))), pb + list(range(eb, len(b)))


def _source(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    told = F.concat_ws(" ", *(F.coalesce(F.length(c).cast("string"), F.lit("-")) for c in ("url", "html")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "url", "html")))
    return src.select(F.unhex(F.sha2(told, 256)).alias("key"), "page_id", "url", "html")


def _parsed(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[str], list[int]]]]]:
    for k in range(0, b.num_rows, 256):
        part = b.slice(k, 256)
        yield part, [page_lines(p) for p in part.column(3).to_pylist()]


def outlines(src: DataFrame) -> DataFrame:
    """(key, page_id, host, path, hashes): `LINE` bytes for each line of a page, a BLAKE2 digest and whether the line is protected.
    `key` is the SHA-256 of a row's id, url and page. Different lines or rows of one digest can't be made on purpose, nor by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b, got in _parsed(big):
                places = [split_url(u) for u in b.column(2).to_pylist()]
                h = [b"".join(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=LINE - 1).digest() + (_SURE if z == ARTICLE else _LOOSE) for x, z in zip(*g, strict=True)) for g in got]
                cols = [b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in zip(*places, strict=True)), pa.array(h, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "page_id", "host", "path", "hashes"])

    return arrow(src, run, "key binary, page_id long, host string, path string, hashes binary")


def texts(src: DataFrame) -> DataFrame:
    """(key, page_id, url, article, body, at, n_lines): the text of an article's lines where none is in doubt, else null and the lines
    that may be deleted among `body`: those of an article with lines in doubt, or the body lines. at: their
    numbers among all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b, got in _parsed(big):
                article, body, at = [], [], []
                for lines, zones in got:
                    sure = DOUBT not in zones
                    own = [x for x, z in zip(lines, zones, strict=True) if z >= ARTICLE]
                    article.append(" ".join(own) if own and sure else None)
                    if own and sure:
                        body.append([])
                        at.append([])
                        continue
                    kinds = (ARTICLE, DOUBT) if own else (BODY,)
                    body.append([x for x, z in zip(lines, zones, strict=True) if z in kinds])
                    at.append([k for k, z in enumerate(zones) if z in kinds])
                cols = [
                    b.column(0), b.column(1), b.column(2), pa.array(article, pa.string()), pa.array(body, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int32())),
                    pa.array([len(g[0]) for g in got], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "page_id", "url", "article", "body", "at", "n_lines"])

    return arrow(src, run, "key binary, page_id long, url string, article string, body array<string>, at array<int>, n_lines int")


def numbered(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(n, host, key, hashes): the different pages with a host, numbered in the order of host, path, id and content."""
    order = ["host", "path", F.col("page_id").asc_nulls_first(), "key"]
    dealt = pages.where("host <> ''").dropDuplicates(["key"]).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.select("host", "key", "hashes", F.monotonically_increasing_id().alias("m")), "order")
    part = F.shiftright("m", 33)
    totals = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    begin, at = [], 0
    for p, n in totals:
        begin.append((p, at))
        at += n
    begin = pages.sparkSession.createDataFrame(begin, "p long, at long")
    return dealt.join(F.broadcast(begin), part == F.col("p")).select((F.col("at") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("n"), "host", "key", "hashes")


def shared_lines(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, shared, common): numbers of a page's lines that are aligned with the page before or after, and of those that neither
    of the two pages protects."""
    a = numbered(pages, scratch)
    b = a.select((F.col("n") - 1).alias("n"), F.col("host").alias("host2"), F.col("key").alias("key2"), F.col("hashes").alias("hashes2"))
    pairs = a.join(b, "n").where("host = host2").select("key", "hashes", "key2", "hashes2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, at, loose = [], [], []
            for k1, h1, k2, h2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, q = aligned(*([h[k : k + LINE - 1] for k in range(0, len(h), LINE)] for h in (h1, h2)))
                both = [(i, j) for i, j in zip(p, q, strict=True) if not h1[i * LINE + LINE - 1] and not h2[j * LINE + LINE - 1]]
                key += [k1, k2]
                at += [p, q]
                loose += [[i for i, _ in both], [j for _, j in both]]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *(pa.array(x, pa.list_(pa.int32())) for x in (at, loose))], names=["key", "at", "loose"])

    found = arrow(pairs, run, "key binary, at array<int>, loose array<int>")
    both = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return found.groupBy("key").agg(both("at").alias("shared"), both("loose").alias("common"))  # two rows a page at most


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared) of each page. Pages are read twice, for their outlines and for their
    texts, so that no copy of the texts is kept between."""
    src = _source(pages, id_col, url_col, html_col)
    shared = shared_lines(outlines(src), Scratch(pages.sparkSession, "html"))
    own = F.expr("filter(body, (x, i) -> NOT coalesce(array_contains(common, at[i]), false))")
    both = texts(src).join(shared, "key", "left").withColumn("own", own)
    text = F.expr("coalesce(article, array_join(CASE WHEN size(own) > 0 THEN own ELSE body END, ' '))")
    out = both.select("page_id", "url", text.alias("text"), "n_lines", F.size(F.coalesce("shared", F.array().cast("array<int>"))).alias("n_shared"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
