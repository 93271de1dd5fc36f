"""URL rules indexed by their rarest literal token.

A rule is a host and path prefix ("example.com/de/": the host and all its subdomains, paths that start so) or a pattern
(a regular expression over the whole url with A-Z lowered). A rule's literal tokens are the runs of a-z and 0-9 that every url
it fits has as whole runs: those of its host and path, or those that are derived from its expression. The urls' own tokens are
counted over all rows, and each rule is filed under its rarest token. A url's tokens fetch the rules filed under them, and
only those run their regular expressions; rules without a token are always tried.

Of the fitting host rules the longest (host and path) decides; equally long ones: the first in the list. Without one, a
url is blocked if a pattern fits it, else allowed. Null urls and urls without "://" have an empty host and path, which no
host rule fits; patterns see a null url as empty. Repeated rows and ids are judged row by row. Line feeds and other control
characters are characters of a url like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow, table

_TOKEN = re.compile(r"[a-z0-9]+")
_ALNUM = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyz0123456789"))


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    length: int  # of host and path; 0 for patterns


def host_rule(text: str, verdict: str) -> Rule:
    """`host/path`: over host and path, written together, the rule is an anchored expression, so one machinery serves both
    kinds. A host has no "/", and a path that isn't empty starts with one."""
    host, slash, path = text.partition("/")
    host = host.lower()
    end = re.escape(slash + path) if slash else r"(?:/|\Z)"
    whole = _TOKEN.findall(re.sub(r"[a-z0-9]+\Z", "", path.lower()))  # a run at the end may go on in the url
    return Rule(text, verdict, rf"\A(?:[^/]*\.)?{re.escape(host)}{end}", (*_TOKEN.findall(host), *whole), len(text))


def pattern_rule(regex: str, verdict: str = "block") -> Rule:
    return Rule(regex, verdict, regex, literal_tokens(regex), 0)


def _apart(nodes: list, first: bool) -> bool:
    """Whether whatever the nodes match starts (or ends) with a character that is in no token. Nothing at all doesn't count."""
    if not nodes:
        return False
    op, arg = nodes[0 if first else -1]
    rest = nodes[1:] if first else nodes[:-1]
    if op is C.LITERAL:
        return arg not in _ALNUM
    if op is C.IN:
        return all(k is C.LITERAL and x not in _ALNUM for k, x in arg)
    if op is C.SUBPATTERN:
        return _apart(list(arg[3]), first)
    if op is C.BRANCH:
        return all(_apart(list(x), first) for x in arg[1])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        return _apart(list(arg[2]), first) and (arg[0] > 0 or _apart(rest, first))
    return op is C.AT and arg in ((C.AT_BEGINNING, C.AT_BEGINNING_STRING) if not first else (C.AT_END_STRING,))


def literal_tokens(regex: str) -> tuple[str, ...]:
    """Tokens that every text which the expression fits has as whole runs of a-z and 0-9: runs of literals between
    characters that are in no token. None where letters' case is ignored or inline flags are set."""
    tree = _parser.parse(regex)
    if tree.state.flags & ~re.UNICODE:
        return ()
    out: set[str] = set()

    def walk(nodes: list) -> None:
        k = 0
        while k < len(nodes):
            op, arg = nodes[k]
            if op is C.LITERAL and arg in _ALNUM:
                end = k
                while end < len(nodes) and nodes[end][0] is C.LITERAL and nodes[end][1] in _ALNUM:
                    end += 1
                if _apart(nodes[:k], False) and _apart(nodes[end:], True):
                    out.add("".join(chr(x) for _, x in nodes[k:end]))
                k = end
                continue
            if op is C.SUBPATTERN:
                walk(list(arg[3]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                walk(list(arg[2]))
            k += 1

    walk(list(tree))
    return tuple(sorted(out))


#: The rules of the query.
HOST_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
PATTERN_RULES = (
    pattern_rule(r"://(?:[^/?#]*\.)?spam-farm\."),
    pattern_rule(r"://(?:[^/?#]*\.)?cheap-pills\."),
    pattern_rule(r"://(?:[^/?#]*[.-])?casino[.-]"),
    pattern_rule(r"[?&]adurl="),
    pattern_rule(r"://(?:[^/?#]*\.)?ads?\.doubleclick\."),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first "://" up to / ? # or the end, A-Z lowered; then up to ? # or the end."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(_AZ), path


_AZ = {c: c + 32 for c in range(65, 91)}


def url_tokens(url: str | None) -> set[str]:
    return set(_TOKEN.findall((url or "").translate(_AZ)))


class Index:
    """Rules by their rarest token. `counts`: how many urls have each token."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.rules = [(r, re.compile(r.regex)) for r in rules]
        self.filed: dict[str, list[int]] = {}
        self.always: list[int] = []
        for k, r in enumerate(rules):
            if r.tokens:
                self.filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """(host, path, deciding host rule, verdict)."""
        host, path = split_url(url)
        low, place = (url or "").translate(_AZ), host + path
        near = [*self.always, *(k for t in url_tokens(url) for k in self.filed.get(t, ()))]
        best, hit = None, None
        for k in sorted(set(near)):
            r, regex = self.rules[k]
            if not regex.search(place if r.length else low):
                continue
            if r.length and host and (best is None or r.length > best.length):
                best = r
            elif not r.length:
                hit = hit or r
        return host, path, best.name if best else None, best.verdict if best else hit.verdict if hit else "allow"


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> dict[str, int]:
    """For each token of the rules, the urls that have it: one pass over all urls, a row a rule token at most back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    listed = pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string")  # the caller's rules
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(F.col(url_col), F.lit(""))), "[^a-z0-9]+"))
    found = pages.select(F.explode(tokens).alias("t")).join(F.broadcast(listed), "t").groupBy("t").agg(F.count("*").alias("n"))
    return {r["t"]: r["n"] for r in found.collect()}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    index = pages.sparkSession.sparkContext.broadcast((rules, token_counts(src, rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Index(*index.value)
        for b in batches:
            rows = [held.judge(u) for u in b.column(1).to_pylist()]
            cols = [pa.array(x, pa.string()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["page_id", "host", "path", "rule", "verdict"])

    return arrow(src, run, "page_id long, host string, path string, rule string, verdict string")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
),
rules(name, rhost, rpath, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
),
m AS (
  SELECT page_id, max_by(name, length(name)) AS rule, max_by(verdict, length(name)) AS v
  FROM p, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, CASE WHEN regexp_matches(
    translate(p.url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '://([^/?#]*\.)?spam-farm\.|://([^/?#]*\.)?cheap-pills\.|://([^/?#]*[.-])?casino[.-]|[?&]adurl=|://([^/?#]*\.)?ads?\.doubleclick\.')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
