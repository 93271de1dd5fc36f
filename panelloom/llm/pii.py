"""Personal data by candidate gradient boosting, all in DataFrame functions.

Base detectors give emails, IP addresses, card numbers and phone numbers: the leftmost non-overlapping matches of a pattern
for each kind, without those that fail its check. Further generators propose spans with high recall (secrets, phone numbers
without a plus, dashed national ids, bank account numbers), which may overlap the base ones and each other. Boosted trees
score each proposal by format features (lengths, counts and changes of character classes) and by words and signs before and
after it; a threshold for each kind, calibrated on examples that the trees were not fitted on, selects. The trees are fitted on the
driver from `examples` synthetic examples (a parameter, the same for every corpus) and run as CASE expressions. Half the
examples are no personal data but look so: digests of commits and files, identifiers and versions in code, ISBNs, order and part
numbers, measures, and what base matches leave over (the tail of a number with a plus is no phone number of its own).

Spans are (kind, start, end) in code points, end exclusive. Null texts count as empty and have no spans; redaction leaves
them null. Repeated rows and further columns stay as they are.

Patterns start only where a run of their first characters starts and quantifiers are possessive where that changes no
match, so matching takes linear time and no recursion on long texts. Positions are sums over the pieces between matches, and
redaction works on blocks of spans, so both are near linear in the number of matches, too.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees as G
from ._common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "local_phone", "national_id", "account")
KINDS = BASE + ADDED

_EMAIL_CH = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_EMAIL_CH}])|\G)[{_EMAIL_CH}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[0-9A-Za-z]{10,}+",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[-.\x20][0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])",
}
#: What a text has if it has a match at all; cheap to look for.
NEEDS = {
    "email": "text LIKE '%@%'",
    "ip": "text RLIKE '[0-9][.][0-9]'",
    "card": "text RLIKE '[0-9]'",
    "phone": "text LIKE '%+%'",
    "secret": "text RLIKE '[0-9]'",
    "local_phone": "text RLIKE '[0-9]{4}'",
    "national_id": "text RLIKE '[0-9]-[0-9]'",
    "account": "text RLIKE '[A-Z]{2}[0-9]{2}'",
}
CHECKS = {
    "ip": "forall(split(x, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM p) AS INT), 0) <= 255)",
    "card": """length(translate(x, ' -', '')) BETWEEN 12 AND 19 AND aggregate(
        transform(split(reverse(translate(x, ' -', '')), ''), (d, k) -> CAST(d AS INT) * (1 + k % 2)),
        0, (a, v) -> a + v - CASE WHEN v > 9 THEN 9 ELSE 0 END) % 10 = 0""",
    "phone": "length(translate(x, '+ ().-', '')) BETWEEN 9 AND 15",
}
BLOCK = 256

FEATURES = (
    "n_chars", "n_digit", "n_lower", "n_upper", "n_other", "n_turns", "hex_only", "w_secret", "w_phone", "w_id", "w_account", "w_code", "w_number",
    "sign", "quote", "after_plus", "after_currency", "before_slash", "unit",
)
_WORDS = {
    "w_secret": ("token", "secret", "passw", "pwd", "api", "key", "auth", "bearer", "credential"),
    "w_phone": ("tel", "phone", "call", "fax", "mobil", "cell", "contact", "reach"),
    "w_id": ("ssn", "social", "national", "passport", "tax"),
    "w_account": ("iban", "account", "konto", "compte", "cuenta", "bank", "transfer"),
    "w_code": ("commit", "sha", "md5", "hash", "digest", "etag", "uuid", "checksum", "index", "blob", "revision", "build", "object", "file", "http", "www"),
    "w_number": ("isbn", "order", "invoice", "ticket", "part", "item", "model", "serial", "sku", "version", "code", "total", "sum", "rows", "ref", "no."),
}
CONTEXT = 24
AFTER = 8


def feature_row(text: str, start: int, end: int) -> list[float]:
    """The features of a proposal, in plain Python; `_feature_sql` has the same for Spark."""
    x, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + AFTER].lower()
    d, lo, up = (sum(c in s for c in x) for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [
        len(x), d, lo, up, len(x) - d - lo - up, len(re.findall("[0-9][A-Za-z]", x)), float(all(c in "0123456789abcdefABCDEF" for c in x)),
        *(float(any(w in before for w in words)) for words in _WORDS.values()),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("'", '"')),
        float(bool(re.search(r"\+[0-9]{1,3}[ .()-]{0,3}\Z", before))), float(bool(re.search(r"[$€£#] ?\Z", before))),
        float(before[-1:] in ("/", "@", "_", "-")), float(bool(re.match(r"( ?(ms|kb|mb|gb|km|kg|eur|usd|%)|[/_.-][0-9a-z])", after))),
    ]


def _feature_sql() -> dict[str, str]:
    count = lambda cls: f"CAST(length(regexp_replace(c.x, '[^{cls}]', '')) AS DOUBLE)"
    test = lambda what, regex: f"CASE WHEN {what} RLIKE '{regex}' THEN 1D ELSE 0D END"
    out = {"n_chars": "CAST(length(c.x) AS DOUBLE)", "n_digit": count("0-9"), "n_lower": count("a-z"), "n_upper": count("A-Z")}
    out["n_other"] = "CAST(length(regexp_replace(c.x, '[0-9A-Za-z]', '')) AS DOUBLE)"
    out["n_turns"] = "CAST(size(regexp_extract_all(c.x, '[0-9][A-Za-z]', 0)) AS DOUBLE)"
    out["hex_only"] = test("c.x", "^[0-9a-fA-F]*$")
    for name, words in _WORDS.items():
        out[name] = test("c.before", "|".join(w.replace(".", "[.]") for w in words))
    out["sign"] = "CASE WHEN regexp_replace(c.before, '[ \"\\']+$', '') RLIKE '[=:]$' THEN 1D ELSE 0D END"
    out["quote"] = test("c.before", "[\"\\']$")
    out["after_plus"] = test("c.before", "[+][0-9]{1,3}[ .()-]{0,3}$")
    out["after_currency"] = test("c.before", "[$€£#] ?$")
    out["before_slash"] = test("c.before", "[/@_-]$")
    out["unit"] = test("c.after", "^( ?(ms|kb|mb|gb|km|kg|eur|usd|%)|[/_.-][0-9a-z])")
    return out


def _examples(n: int, seed: int = 11) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Synthetic proposals for each added kind: features, and whether they are personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    chars = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(int(rng.integers(a, b + 1))))
    dig, hexs, low, up = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    prose = lambda: " ".join(chars(low, 2, 9) for _ in range(int(rng.integers(2, 6)))) + " "
    lead = {"secret": "w_secret", "local_phone": "w_phone", "national_id": "w_id", "account": "w_account"}
    mixed = lambda a, b: pick((chars(hexs, a, b), chars(dig + low + up, a, b), chars(dig + up, a, b)))
    phone = lambda s: f"{pick(('(%s)', '%s')) % chars(dig, 3, 3)}{s}{chars(dig, 3, 3)}{s}{chars(dig, 4, 4)}"
    part = lambda: f"{chars(dig, 3, 3)}-{chars(dig, 2, 2)}-{chars(dig, 4, 4)}"
    account = lambda: chars(up, 2, 2) + chars(dig, 2, 2) + pick((chars(dig, 11, 20), chars(up, 4, 4) + chars(dig, 10, 16)))

    def yes(kind: str) -> tuple[str, str, str]:
        word = pick(_WORDS[lead[kind]])
        before = pick((f"{word}=", f"{word} = \"", f"{word}: ", f"my {word} is ", f"{word} ", f"{word}: '"))
        after = pick((" and", ".", "\"", ", ", ""))
        if kind == "secret":
            x = mixed(49, 160) if rng.random() < 0.2 else mixed(12, 48)
            return prose() + (before if rng.random() < 0.75 or len(x) < 30 else ""), x, after
        x = {"local_phone": lambda: phone(pick("-. ")), "national_id": part, "account": account}[kind]()
        return prose() + (before if rng.random() < 0.6 else ""), x, after

    def no(kind: str) -> tuple[str, str, str]:
        number = pick(_WORDS["w_number"]) + pick((" ", ": ", "=", " no. ", "-"))
        if kind == "secret":
            if rng.random() < 0.5:  # digests and identifiers in code
                word = pick(_WORDS["w_code"])
                before = pick((f"{word} ", f"{word}: ", f"{word}=", f"{word} = \"", f"{word}/", f"{word} {chars(hexs, 4, 7)}.."))
                return prose() + before, pick((chars(hexs, 10, 64), chars(hexs, 32, 64), chars(dig + low + up, 10, 22))), pick((" ", "..", "/x", ".js", "\""))
            x = pick((chars(low, 8, 20) + chars(dig, 1, 4), chars(up, 1, 4) + chars(dig, 6, 12), "the" + chars(low, 6, 14) + chars(dig, 1, 2), chars(dig, 8, 12) + chars(low, 2, 3)))
            if rng.random() < 0.15:
                x = pick((chars(low, 21, 160) + chars(dig, 1, 4), chars(dig, 21, 160) + chars(low, 1, 3)))
            return prose() + pick(("", number, "in ", "see ", f"{pick(_WORDS['w_secret'])} ")), x, pick((" ", "_2", "kb", ". "))
        if kind == "local_phone":
            if rng.random() < 0.4:  # the tail of a number with a plus
                return prose() + pick(("", "call ", "tel: ")) + "+" + chars(dig, 1, 3) + pick((" ", "-", "", ".")), phone(pick("-. ")), pick((" and", ".", ""))
            s = pick(" .-")
            return prose() + pick((number, "$ ", "# ", number)), f"{chars(dig, 3, 3)}{s}{chars(dig, 3, 3)}{s}{chars(dig, 4, 4)}", pick((" km", " eur", "", "."))
        if kind == "national_id":
            return prose() + pick((number, "isbn ", "# ")), part(), pick(("", " ", "/7", "."))
        return prose() + number, pick((account(), chars(up, 2, 2) + chars(dig, 2, 2) + chars(up + dig, 11, 16))), pick((" ", "-2", ". "))

    xs, ys = {}, {}
    for kind in ADDED:
        rows, y = [], []
        for k in range(n):
            before, x, after = (yes if k % 2 else no)(kind)
            rows.append(feature_row(before + x + after, len(before), len(before) + len(x)))
            y.append(k % 2)
        xs[kind], ys[kind] = np.array(rows), np.array(y, dtype=float)
    return xs, ys


@lru_cache(maxsize=4)
def fit(examples: int = 2400, rounds: int = 20, precision: float = 0.95) -> dict[str, tuple[float, list, float]]:
    """For each added kind (bias, trees, threshold on the log odds). Of the thresholds at which the calibration third of the
    examples has the asked precision, the one with the largest F1 (of equal ones the highest), half way down to the next score."""
    xs, ys = _examples(examples)
    out = {}
    for kind in ADDED:
        held = np.arange(examples) % 3 == 2
        bias, trees = G.boost(xs[kind][~held], ys[kind][~held], rounds=rounds, depth=3, least=8)
        z = bias + sum(t.predict(xs[kind][held]) for t in trees)
        order = np.argsort(-z, kind="stable")
        hits, n = np.cumsum(ys[kind][held][order]), np.arange(1, len(order) + 1)
        z = z[order]
        ok = (hits / n >= precision) & np.append(z[1:] < z[:-1], True)
        f1 = np.where(ok, 2 * hits / (n + max(hits[-1], 1)), -1)
        k = int(f1.argmax())
        least = (z[k] + z[min(k + 1, len(z) - 1)]) / 2
        out[kind] = (bias, trees, float(least) if ok[k] else float("inf"))
    return out


def _placed(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """`df` (with `text`) with an array at_<kind> of (start, x) of the pattern's matches for each kind."""
    df = df.withColumns({f"m_{k}": F.when(F.expr(NEEDS[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))) for k in kinds})
    gaps = {k: F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", PATTERNS[k], -1), lambda g: F.length(g))) for k in kinds}
    df = df.withColumns({f"g_{k}": c for k, c in gaps.items()})
    df = df.withColumns({f"s_{k}": F.expr(f"zip_with(m_{k}, slice(g_{k}, 1, size(m_{k})), (m, g) -> length(m) + g)") for k in kinds})
    sums = "transform(sequence(0, (size({s}) - 1) div {b}), b -> aggregate(slice({s}, b * {b} + 1, {b}), 0, (a, v) -> a + v))"
    df = df.withColumns({f"b_{k}": F.when(F.size(f"m_{k}") > 0, F.expr(sums.format(s=f"s_{k}", b=BLOCK))) for k in kinds})
    df = df.withColumns({f"p_{k}": F.expr(f"transform(b_{k}, (v, b) -> aggregate(slice(b_{k}, 1, b), 0, (a, v2) -> a + v2))") for k in kinds})
    at = """transform(m_{k}, (x, i) -> named_struct('start', p_{k}[i div {b}] + g_{k}[i]
        + aggregate(slice(s_{k}, (i div {b}) * {b} + 1, i % {b}), 0, (a, v) -> a + v), 'x', x))"""
    df = df.withColumns({f"at_{k}": F.expr(at.format(k=k, b=BLOCK)) for k in kinds})
    return df.drop(*(f"{p}_{k}" for p in "mgsbp" for k in kinds))


def _span(k: str, cond: str) -> Column:
    """Spans (start, kind number, end) of the matches that pass."""
    return F.expr(
        f"coalesce(transform(filter(at_{k}, c -> {cond}), c -> named_struct('start', c.start, 'kind', {KINDS.index(k)}, 'end', c.start + length(c.x))),"
        " CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT>>))"
    )


def find_spans(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """`docs` with __base and __spans: arrays of (start, kind number, end), ordered, of the base detectors and of all."""
    model = fit() if model is None else model
    df = docs.withColumn("__doc", F.struct(*docs.columns)).select("__doc", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = _placed(df, KINDS)
    checks = {k: CHECKS.get(k, "true").replace("(x,", "(c.x,").replace(" x)", " c.x)") for k in BASE}
    for k in ADDED:
        before = f"lower(substring(text, greatest(c.start - {CONTEXT}, 0) + 1, least(c.start, {CONTEXT})))"
        after = f"lower(substring(text, c.start + length(c.x) + 1, {AFTER}))"
        context = f"transform(at_{k}, c -> named_struct('start', c.start, 'x', c.x, 'before', {before}, 'after', {after}))"
        features = ", ".join(f"'{n}', {sql}" for n, sql in _feature_sql().items())
        df = df.withColumn(f"at_{k}", F.expr(context))
        df = df.withColumn(f"at_{k}", F.expr(f"transform(at_{k}, c -> named_struct('start', c.start, 'x', c.x, {features}))"))
        bias, trees, least = model[k]
        score = " + ".join([f"{bias!r}D", *(t.sql([f"c.{n}" for n in FEATURES]) for t in trees)])
        checks[k] = f"{score} >= {least!r}D" if np.isfinite(least) else "false"
    df = df.withColumns({f"at_{k}": _span(k, checks[k]) for k in KINDS})
    base = F.array_sort(F.concat(*(f"at_{k}" for k in BASE)))
    return df.select("__doc.*", base.alias("__base"), F.array_sort(F.concat(*(f"at_{k}" for k in KINDS))).alias("__spans"))


def _joined(col: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({col}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    counts = [F.expr(f"CAST(size(filter(__base, s -> s.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", model: dict | None = None) -> DataFrame:
    """`docs` with each maximal run of overlapping spans replaced by its first span's kind in angle brackets. Where there
    is a column n_chars it is set anew."""
    found = find_spans(docs, text_col, model)
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    text = f"`{text_col}`"
    # A block starts behind the largest end of the blocks before it, so blocks are made apart and joined.
    found = found.withColumn("__tops", F.expr(f"transform(sequence(0, greatest(size(__spans) - 1, 0) div {BLOCK}), b -> array_max(transform(slice(__spans, b * {BLOCK} + 1, {BLOCK}), s -> s.end)))"))
    block = f"""aggregate(slice(__spans, b * {BLOCK} + 1, {BLOCK}),
        named_struct('at', coalesce(array_max(slice(__tops, 1, b)), 0), 'out', CAST(array() AS ARRAY<STRING>)), (a, s) ->
        CASE WHEN s.start >= a.at THEN named_struct('at', s.end, 'out', concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), {names}[s.kind])))
        ELSE named_struct('at', greatest(a.at, s.end), 'out', a.out) END, a -> array_join(a.out, ''))"""
    pieces = f"concat(array_join(transform(__tops, (t, b) -> {block}), ''), substring({text}, array_max(__tops) + 1))"
    new = F.when(F.size("__spans") > 0, F.expr(pieces)).otherwise(F.col(text_col))
    out = found.withColumn(text_col, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
