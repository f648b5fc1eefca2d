"""Scalar expressions: Column in, Column out, all of built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafolio.params import DEFAULT, Params

# fixed values: accented letters and what they are without accents
ACCENTED = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUCN"
# fixed values: first words of street names and their full forms
STREET_WORDS = {
    "R": "RUA", "AV": "AVENIDA", "AL": "ALAMEDA", "PC": "PRACA", "PCA": "PRACA", "ES": "ESTRADA", "EST": "ESTRADA",
    "TV": "TRAVESSA", "VD": "VIADUTO", "LG": "LARGO", "PQ": "PARQUE", "PRQ": "PARQUE", "ROD": "RODOVIA", "RV": "RODOVIA",
}
# fixed values: codes of payment and their names
PAYMENTS = (("1.", "sfh"), ("2.", "mcmv"), ("3.", "consorcio"), ("99.", "sfi"))
#: What a column must look like to be read as a number: Spark's cast takes more, such as ``1d``.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def half_up(x: Column, digits: int = 0) -> Column:
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def no_accents(text: Column) -> Column:
    return F.translate(F.upper(text), ACCENTED, PLAIN)


def number(text: Column) -> Column:
    """A number in plain or scientific notation; null for anything else."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def _bare(text: Column) -> Column:
    """Accents and marks deleted, white space collapsed."""
    kept = F.regexp_replace(F.translate(F.upper(text), ACCENTED, PLAIN), r"[^A-Z0-9\p{IsWhite_Space}]", "")
    return F.trim(F.regexp_replace(kept, r"\p{IsWhite_Space}+", " "))


def place_name(text: Column) -> Column:
    """Upper case; what is in parentheses or quotes, accents and marks are deleted; single spaces."""
    return _bare(F.regexp_replace(F.regexp_replace(F.upper(text), r"\([^)]*\)", ""), r'"[^"]*"', ""))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, in which the value is computed once however often it is used."""
    return F.transform(F.array(value), of)[0]


def street_name(text: Column) -> Column:
    """Upper case without accents and marks, the first word written out. What is in parentheses stays."""
    words = F.create_map(*[F.lit(x) for kv in STREET_WORDS.items() for x in kv])

    def full(clean: Column) -> Column:
        first = F.substring_index(clean, " ", 1)
        return F.concat(F.coalesce(words[first], first), F.substring(clean, F.length(first) + 1, F.length(clean)))

    return let(_bare(text), full)


def street_number(text: Column) -> Column:
    """Without a decimal tail of zeros at the very end, then without leading zeros; a lone zero stays."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\.0+$", "")), r"^0+(?=\d)", "")


def address_key(street: Column, number: Column) -> Column:
    parts = F.struct(street_name(street).alias("s"), street_number(number).alias("n"))
    return let(parts, lambda x: F.when((F.length(x["s"]) > 0) & (F.length(x["n"]) > 0), F.concat_ws("|", x["s"], x["n"])))


def cadastre_id(text: Column) -> Column:
    """11 digits or more, from positive numbers in any notation, decimals cut off; null for all else."""
    digits = let(number(text), lambda x: F.when(x >= 1, F.floor(x).cast("string")))
    return let(digits, lambda x: F.when(F.length(x) < 11, F.lpad(x, 11, "0")).otherwise(x))


def unit_number(text: Column) -> Column:
    """Number of a flat in an address complement, of four digits at most; null if there is none."""
    found = F.regexp_extract(text, r"(?i)(?:\bAP|\bAPTO|\bAPT|\bAPARTAMENTO)\.?\s*0*(\d{1,4})\b", 1)
    return F.when(found != "", found.try_cast("int"))


def parking_spaces(text: Column) -> Column:
    """Number of parking spaces in an address complement, the digit before them; one where a space is named without a number."""
    found = F.regexp_extract(text, r"(?i)(\d)\s*V\s?G", 1)
    return F.when(found != "", found.try_cast("int")).when(text.rlike(r"(?i)\bE\s*V\s?G|\bVAGA\b"), 1)


def area_band(area: Column, p: Params = DEFAULT) -> Column:
    """Half-open bands (lo, hi]; 0 counts in the first, negative areas in none."""
    a, b, c = p.area_edges
    return F.when(area < 0, None).when(area <= a, "ate_50").when(area <= b, "50_80").when(area <= c, "80_120").when(area > c, "mais_120")


def payment_category(code: Column) -> Column:
    code = F.trim(code)
    out = F.when(code.isNull() | (code == ""), "a_vista")
    for start, name in PAYMENTS:
        out = out.when(code.startswith(start), name)
    return out.otherwise("outros")


def full_transfer(share: Column) -> Column:
    """A share of 99.99 % or more; unknown shares count as full."""
    return F.coalesce(number(share) >= 99.99, F.lit(True))


def price_alignment(ratio: Column) -> Column:
    """Points for an asking price against its reference: 100 from 70 % to 100 %, falling on both sides; 50 if unknown."""
    above, below = F.greatest(F.lit(0.0), 100 - (ratio - 1) * 100), F.greatest(F.lit(30.0), 100 - (0.7 - ratio) * 200)
    return F.when(ratio.isNull(), 50.0).when(ratio > 1, above).when(ratio >= 0.7, 100.0).otherwise(below)


def band_adherence(value: Column, low: Column, high: Column) -> Column:
    """100 inside the band, falling by the distance in widths of the band; 50 if that has no width."""
    width = high - low
    away = F.greatest(low - value, value - high)
    return F.when(value.isNull() | low.isNull() | high.isNull(), None).when(away <= 0, 100.0).when(width <= 0, 50.0).otherwise(F.greatest(F.lit(0.0), 100 - 100 * away / width))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the parts that aren't null; null if all are."""
    total = sum((F.when(v.isNotNull(), w * v).otherwise(0.0) for w, v in parts), F.lit(0.0))
    weights = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    return F.when(weights > 0, total / weights)


def interpolated(xs: list[float], ys: Column, x: Column) -> Column:
    """Piecewise linear through (xs, ys), held constant beyond the ends; ``ys`` is an array as long as ``xs``."""
    out = F.when(x <= xs[0], ys[0])
    for i in range(1, len(xs)):
        part = (x - xs[i - 1]) / (xs[i] - xs[i - 1])
        out = out.when(x <= xs[i], ys[i - 1] + part * (ys[i] - ys[i - 1]))
    return out.otherwise(ys[len(xs) - 1])
