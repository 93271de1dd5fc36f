"""Scalar functions as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.grid import finite

__all__ = [
    "age_hours", "alveolar_oxygen", "attenuation", "bucket", "clip", "emax", "field", "finite", "hill", "is_missing", "lean_mass",
    "normalize_item", "number_in", "per_minute", "saturation", "scaled", "time_in_text", "to_ascii", "to_number", "truthy",
]



@cache
def _compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """What Unicode's compatibility decomposition (NFKD) leaves of each character beyond ASCII once all that isn't ASCII is dropped:
    (one character for one, several or another number of characters for one). Characters that leave nothing are in neither."""
    one, more = {}, {}
    for i in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= i < 0xE000:
            left = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if ord(c) < 0x80)
            if left:
                (one if len(left) == 1 else more)[chr(i)] = left
    return one, more


def to_ascii(x: Column) -> Column:
    """The text in compatibility decomposition without all that isn't ASCII. ASCII text is left as it is; characters that stand for one
    are translated, and only a text with one that stands for several is taken apart."""
    one, more = _compatibility()
    several = "[" + "".join(more) + "]"
    known = F.create_map(*[F.lit(v) for pair in more.items() for v in pair])
    apart = F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    whole = F.when(x.rlike(several), apart).otherwise(x)
    plain = F.regexp_replace(F.translate(whole, "".join(one), "".join(one.values())), r"[^\x00-\x7F]+", "")
    return F.when(x.rlike(r"[^\x00-\x7F]"), plain).otherwise(x)


def normalize_item(x: Column) -> Column:
    """Lower case of the text's ASCII form (accents, ligatures, widths and superscripts resolved, what has no ASCII form dropped), other
    runs than letters and digits as one underscore, none at the ends; whole numbers without their decimals."""
    plain = F.lower(to_ascii(F.regexp_replace(x.cast("string"), r"^(-?[0-9]+)\.0+$", "$1")))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def is_missing(x: Column) -> Column:
    """Null, NaN, empty, "none" or "nan", whatever the case and the blanks around."""
    return x.isNull() | F.lower(F.trim(x.cast("string"))).isin("", "none", "nan")


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "1.0", "true", "yes", "y", "t"), F.lit(False))


def to_number(x: Column) -> Column:
    """The finite number a string holds, else null."""
    return finite(x.try_cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def bucket(key: Column, n: int) -> Column:
    """SHA-256 of the key's text, as an unsigned number, modulo n: stable under appends and across engines."""
    digits = F.filter(F.split(F.sha2(key.cast("string"), 256), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("long")) % n)


def time_in_text(x: Column) -> Column:
    """Seconds of a text that begins like "t=12.5s"."""
    return F.nullif(F.regexp_extract(x, r"^t=([0-9.]+)s", 1), F.lit("")).try_cast("double")


def number_in(x: Column) -> Column:
    """The amount before "mg/min" or "mcg/min", in mg/min."""
    v = F.nullif(F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)\s*(m(?:g|cg))/min", 1), F.lit("")).try_cast("double")
    return F.when(F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)\s*(m(?:g|cg))/min", 2) == "mcg", v / 1000).otherwise(v)


def field(doc: Column, *names: str) -> Column:
    """The first of the named fields that a JSON document has."""
    return F.coalesce(*[F.get_json_object(doc, f"$.{n}") for n in names])


def per_minute(x: Column, unit: Column) -> Column:
    """Rates in units an hour, a minute or a second, a minute."""
    return F.when(unit == "/h", x / 60).when(unit == "/s", x * 60).when(unit == "/min", x)


def age_hours(seconds: Column) -> Column:
    return seconds / 3600.0


def hill(x: Column, half: float, gamma: float) -> Column:
    """x^g / (x^g + half^g) of non-negative x."""
    p = F.pow(F.greatest(x, F.lit(0.0)), F.lit(float(gamma)))
    return p / (p + F.lit(float(half) ** gamma))


def emax(x: Column, base: float, top: float, half: float, gamma: float = 1.0) -> Column:
    return F.lit(float(base)) + (F.lit(float(top)) - F.lit(float(base))) * hill(x, half, gamma)


def attenuation(x: Column, middle: float, slope: float) -> Column:
    return 1 / (1 + F.exp((x - middle) * slope))


def saturation(po2: Column) -> Column:
    """Haemoglobin saturation of an oxygen pressure (mmHg), Severinghaus' equation, 0 to 1."""
    p = F.greatest(po2, F.lit(0.1))
    return 1 / (F.lit(23400.0) / (p * p * p + 150 * p) + 1)


def alveolar_oxygen(fio2: Column, pco2: Column, pressure: float = 760.0, water: float = 47.0, quotient: float = 0.8) -> Column:
    return fio2 * (pressure - water) - pco2 / quotient


def lean_mass(weight: Column, height_cm: Column, male: Column) -> Column:
    """James' formula in kg."""
    r = (weight / height_cm) * (weight / height_cm)
    return F.when(male, 1.1 * weight - 128 * r).otherwise(1.07 * weight - 148 * r)


def scaled(x: Column, weight: Column, power: float = 0.75, standard: float = 70.0) -> Column:
    """Allometric scaling by weight."""
    return x * F.pow(weight / standard, F.lit(power))
