"""Quantities and dates that texts state, brought to one value and unit each, so that a claim's can be sought in its source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quotes import MONTHS, _month

# What magnitudes, currencies and units are worth.
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "tn": 1e12, "trillion": 1e12}
CURRENCIES = {"$": "USD", "us$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP", "¥": "JPY", "jpy": "JPY", "yen": "JPY", "₴": "UAH", "uah": "UAH", "грн": "UAH"}
UNITS = {
    "%": ("share", 1.0), "percent": ("share", 1.0), "per cent": ("share", 1.0), "відсотків": ("share", 1.0), "відсотки": ("share", 1.0), "відсотка": ("share", 1.0),
    "m": ("length", 1.0), "metres": ("length", 1.0), "meters": ("length", 1.0), "km": ("length", 1e3), "kilometres": ("length", 1e3), "kilometers": ("length", 1e3), "mile": ("length", 1609.344), "miles": ("length", 1609.344),
    "km/h": ("speed", 1.0), "kph": ("speed", 1.0), "mph": ("speed", 1.609344),
    "g": ("mass", 1.0), "grams": ("mass", 1.0), "kg": ("mass", 1e3), "kilograms": ("mass", 1e3), "t": ("mass", 1e6), "tonnes": ("mass", 1e6), "lb": ("mass", 453.59237), "lbs": ("mass", 453.59237), "pounds": ("mass", 453.59237),
    "kb": ("data", 1e3), "mb": ("data", 1e6), "gb": ("data", 1e9), "tb": ("data", 1e12),
}
#: Relative difference up to which two values are the same quantity.
TOLERANCE = 0.005

_NAMED = "(" + "|".join(MONTHS) + ")"
_ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"
_DMY = rf"(?i)\b(\d{{1,2}})\s+{_NAMED}\s+(\d{{4}})\b"
_MDY = rf"(?i)\b(?=[{''.join(sorted({m[0] for m in MONTHS}))}]){_NAMED}\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
_WORDS = sorted([*(u for u in UNITS if u != "%"), *(c for c in CURRENCIES if c.isalpha())], key=len, reverse=True)
#: A year is no number of something: "in 2000" is one, "2000 grams" and "USD 2000" are not.
_YEAR = r"(?i)(?=19|20)(?<![\d.,$€£¥₴])(?<!\b(?:usd|eur|gbp|jpy|uah)\s)\b((?:19|20)\d{2})(?![\d]|[.,]\d|[\s-]?(?:%|(?:" + "|".join([*_WORDS, *MAGNITUDES]) + r")(?![\w/])))"
_QUANTITY = (
    r"(?i)(?=[0-9$€£¥₴uegj])(?:(us\$|[$€£¥₴])\s?|\b(usd|eur|gbp|jpy|uah)\s)?(?<![\w.,])([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)(?![0-9])"
    r"(?:[\s-]?(trillion|billion|million|thousand|bn|tn|mn|[kmb])(?![\w/]))?(?:[\s-]?(%|(?:" + "|".join(_WORDS) + r")(?![\w/])))?"
)


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row: a column named in several places, or inside a lambda, is computed at each and for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stated_dates(text: Column) -> Column:
    """array<string>: each date in figures or words as yyyy-mm-dd, each other year as yyyy; distinct."""
    all_of = lambda t, p, k: F.regexp_extract_all(t, F.lit(p), F.lit(k))
    parts = lambda x, p, order: F.split(F.regexp_replace(x, p, order), "\x01")
    dated = lambda t, p, order: F.transform(F.transform(all_of(t, p, 0), lambda x: parts(x, p, order)), lambda x: F.concat_ws("-", F.get(x, 0), _month(F.get(x, 1)), F.lpad(F.get(x, 2), 2, "0")))
    return _once(text, lambda t: F.array_distinct(F.concat(all_of(t, _ISO, 0), dated(t, _DMY, "$3\x01$2\x01$1"), dated(t, _MDY, "$3\x01$1\x01$2"), all_of(_without_dates(t), _YEAR, 1))))


def _without_dates(text: Column) -> Column:
    for p in (_ISO, _DMY, _MDY):
        text = F.regexp_replace(text, p, " ")
    return text


def quantities(text: Column) -> Column:
    """array<struct<kind, unit, value, stated>>: numbers with their magnitude, as stated and in one unit of each kind; dates and years are left out.

    Money keeps its currency as the unit; shares are in percent, lengths in metres, speeds in km/h, masses in grams, data in
    bytes. "m" after a number is a million where a currency stands with it, else metres.
    """
    bare = F.regexp_replace(_without_dates(text), _YEAR, " ")
    # the text is searched once; a match holds its parts wherever it stands
    parts = F.transform(F.regexp_extract_all(bare, F.lit(_QUANTITY), F.lit(0)), lambda x: F.split(F.regexp_replace(x, _QUANTITY, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01"))
    named = F.transform(parts, lambda x: F.struct(*(F.element_at(x, k + 1).alias(n) for k, n in enumerate(("sign", "code", "number", "magnitude", "unit")))))

    # each step names what the next ones read more than once, so that every table is searched once a number
    def known(x: Column) -> Column:
        unit = F.lower(x["unit"])
        code = F.coalesce(F.when((x["sign"] != "") | (x["code"] != ""), _lookup(F.lower(F.concat(x["sign"], x["code"])), CURRENCIES)), F.when(x["unit"] != "", _lookup(unit, CURRENCIES)))
        return F.struct(code.alias("code"), unit.alias("unit"), F.lower(x["magnitude"]).alias("magnitude"), F.replace(x["number"], F.lit(","), F.lit("")).cast("double").alias("number"))

    def scaled(x: Column) -> Column:
        metres = (x["magnitude"] == "m") & x["code"].isNull() & (x["unit"] == "")
        number = x["number"] * F.when(metres | (x["magnitude"] == ""), 1.0).otherwise(F.coalesce(_lookup(x["magnitude"], MAGNITUDES), F.lit(1.0)))
        unit = F.when(metres, F.lit("m")).otherwise(x["unit"])
        return F.struct(x["code"].alias("code"), number.alias("number"), F.when(x["code"].isNull() & (unit != ""), _lookup(unit, {u: k for k, u in enumerate(UNITS)})).alias("of"))

    def value(x: Column) -> Column:
        kinds, worth = (F.array(*(F.lit(u[k]) for u in UNITS.values())) for k in (0, 1))
        at = lambda a: F.get(a, x["of"])
        kind = F.when(x["code"].isNotNull(), "money").otherwise(F.coalesce(at(kinds), F.lit("number")))
        return F.struct(kind.alias("kind"), F.coalesce(x["code"], F.lit("")).alias("unit"), (x["number"] * F.coalesce(at(worth), F.lit(1.0))).alias("value"), x["number"].alias("stated"))

    return F.transform(F.transform(F.transform(named, known), scaled), value)


def unsupported_quantities(claim: Column, source: Column, tolerance: float = TOLERANCE) -> Column:
    """The claim's quantities that its source does not state within the tolerance, in the same kind and unit.

    A number without a unit is supported by that number with any unit. ``claim`` and ``source`` are columns of ``quantities``.
    """

    def same(a: Column, b: Column) -> Column:
        near = lambda k: F.abs(a[k] - b[k]) <= tolerance * F.greatest(F.abs(a[k]), F.abs(b[k]))
        return F.when(a["kind"] == "number", near("stated")).otherwise(near("value") & (a["kind"] == b["kind"]) & (a["unit"] == b["unit"]))

    return _once(source, lambda s: F.filter(claim, lambda a: ~F.exists(s, lambda b: same(a, b))))


def unsupported_dates(claim: Column, source: Column) -> Column:
    """The claim's dates that its source lacks; a year alone is supported by any date in it. Columns of ``stated_dates``."""
    return _once(source, lambda held: F.filter(claim, lambda d: ~F.exists(held, lambda s: (s == d) | ((F.length(d) == 4) & s.startswith(d)))))
