"""Parsers for listing text: each maps a text column to a typed column.

All patterns run with ``(?U)`` so that digits, blanks and word edges follow
Unicode, as the text does (no-break spaces are common in scraped pages).
Casts are ``try_cast``: text that is no number gives NULL, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystead.functions.numeric import half_even, let, round_exact

# The characters trimmed as white space: all that Unicode counts as such.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Patterns of the listing texts.
PRICE_RANGE = r"(?iU)([\d.]+)\s*[-–]\s*([\d.]+)\s*(Cr|Crore|Lac|L)\b"
PRICE_SINGLE = r"(?iU)([\d.]+)\s*(Crore|Cr|Lac|L)\b"
BEDROOM_RANGE = r"(?iU)(\d+)\s*[-–]\s*(\d+)\s*BHK"
AREA_RANGE = r"(?iU)([\d,]+)\s*[-–]\s*([\d,]+)\s*sqft"
AREA_LABELLED = r"(?iU)(?:Super Built-?up area|Built\s*Up\s*area|Carpet\s*area)\s*:?\s*([\d,]+)"
AREA_SQFT = r"(?iU)([\d,]+)\s*sqft"
AREA_ANY = r"(?U)([\d,]+)"
FIRST_INT = r"(?U)(\d+)"
SIGNED_INT = r"(?U)(-?\d+)"
BALCONY_COUNT = r"(?U)(\d+\+?)"
STAR_RATING = r"(?U)\d+(\.\d+)?\s?★"
DESC_BEDROOMS = r"(?iU)(\d(?:\s*,\s*\d)*)\s*BHK"
DESC_PRICE = r"(?iU)Rs\.?\s*([\d.]+)\s*(L|Lac|Cr)?\s*[-–]\s*([\d.]+)\s*(L|Lac|Cr)"
DESC_AREA = r"(?iU)([\d,]+)\s*[-–]\s*([\d,]+)\s*(sqft|sq\.\s*ft\.?)"

# Cell texts that a CSV round trip turns into a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """True for NULL and for text of white space only."""
    return F.coalesce(~F.rlike(c, F.lit(r"(?U)\S")), F.lit(True))


def missing_to_null(c: Column) -> Column:
    """NULL for the texts that mean "missing" in a stage file."""
    return F.when(~c.isin(MISSING_TEXTS), c)


def _extract_if(c: Column, holds: Column, pattern: str, group: int) -> Column:
    """``regexp_extract`` where ``holds`` says that the pattern may occur; elsewhere what it gives without a match."""
    return F.when(~holds, F.lit("")).otherwise(F.regexp_extract(c, pattern, group))


def _has_any(c: Column, *parts: str) -> Column:
    """The text holds one of these parts letter by letter, which every match of a pattern needs."""
    return reduce(lambda a, b: a | b, [c.contains(part) for part in parts])


def _has_dash(c: Column) -> Column:
    return _has_any(c, "-", "–")


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _per_crore(unit: Column) -> Column:
    """How many of the unit make one crore: 100 lac, or 1."""
    return F.when(F.upper(unit).startswith("L"), F.lit(100.0)).otherwise(F.lit(1.0))


def price_to_cr(c: Column) -> Column:
    """Price text to crore: the midpoint of a range, or the single value."""
    s = F.replace(c, F.lit("₹"), F.lit(""))
    range_unit = _extract_if(s, _has_dash(s), PRICE_RANGE, 3)
    midpoint = (
        _number(F.regexp_extract(s, PRICE_RANGE, 1)) + _number(F.regexp_extract(s, PRICE_RANGE, 2))
    ) / 2
    single_unit = F.regexp_extract(s, PRICE_SINGLE, 2)
    single = _number(F.regexp_extract(s, PRICE_SINGLE, 1))
    crore = F.when(range_unit != "", midpoint / _per_crore(range_unit)).when(
        single_unit != "", single / _per_crore(single_unit)
    )
    return F.when(~c.contains("on Request"), round_exact(crore, 4))


def bedrooms(c: Column) -> Column:
    """Upper end of a ``2-3 BHK`` range, else the first number."""
    upper = _extract_if(c, _has_dash(c), BEDROOM_RANGE, 2)
    return F.coalesce(F.nullif(upper, F.lit("")), F.regexp_extract(c, FIRST_INT, 1)).try_cast("int")


def area_sqft(c: Column) -> Column:
    """Square feet from an area text, by four formats in order."""
    low, high = (_extract_if(c, _has_dash(c), AREA_RANGE, g) for g in (1, 2))
    labelled = F.regexp_extract(c, AREA_LABELLED, 1)
    plain = F.regexp_extract(c, AREA_SQFT, 1)
    bare = _number(F.regexp_extract(c, AREA_ANY, 1))
    return (
        F.when(high != "", half_even((_number(low) + _number(high)) / 2))
        .when(labelled != "", _number(labelled))
        .when(plain != "", _number(plain))
        .when(bare > 100, bare)
    )


def first_int(c: Column) -> Column:
    """The first whole number in a text."""
    return F.regexp_extract(c, FIRST_INT, 1).try_cast("int")


def balcony(c: Column) -> Column:
    """``0``, a count, or a count with plus sign; blank stays blank (P5)."""
    s = strip(F.coalesce(c, F.lit("")))
    count = F.regexp_extract(s, BALCONY_COUNT, 1)
    return (
        F.when(s.contains("No"), F.lit("0"))
        .when(count != "", count)
        .otherwise(F.regexp_extract(s, r"(?U)^(\S*)", 1))
    )


def floor_number(c: Column) -> Column:
    """Floor as a number; ground and lower are 0, basement is -1."""
    s = F.when(_has_any(c, "Ground", "Lower"), F.regexp_replace(c, r"(?U)\b(?:Ground|Lower)\b", "0")).otherwise(c)
    s = F.when(_has_any(c, "Basement"), F.regexp_replace(s, r"(?U)\bBasement\b", "-1")).otherwise(s)
    return F.regexp_extract(s, SIGNED_INT, 1).try_cast("double")


def society(c: Column, kind: Column) -> Column:
    """Society name without its star rating; a house without one is ``independent``."""
    given = F.coalesce(c, F.lit(""))
    unrated = F.when(given.contains("★"), F.regexp_replace(given, STAR_RATING, "")).otherwise(given)
    name = F.lower(strip(unrated))
    unnamed = F.when(kind == "house", F.lit("independent")).otherwise(F.lit(""))
    return let(name, lambda n: F.when(n.isin("", "nan"), unnamed).otherwise(n))


def rate_per_sqft(c: Column) -> Column:
    """Price per square foot: the digits and dots of the text as one number."""
    digits = F.regexp_replace(c, r"(?U)[^\d.]+", "")
    single = F.when(digits.contains(".."), F.regexp_replace(digits, r"\.+", ".")).otherwise(digits)
    return F.rtrim(single, F.lit(".")).try_cast("double")


def description_facts(c: Column) -> Column:
    """Bedroom, price and area ranges that a free description states.

    Each pattern searches the description once; the parts are then taken from
    the short piece it found.
    """

    def found(pattern: str, read) -> Column:
        return let(F.regexp_extract(c, pattern, 0), read)

    def rooms(piece: Column) -> Column:
        numbers = F.transform(
            F.split(F.regexp_extract(piece, DESC_BEDROOMS, 1), ","), lambda x: strip(x).try_cast("int")
        )
        return let(numbers, lambda n: F.struct(F.array_min(n).alias("min"), F.array_max(n).alias("max")))

    def prices(piece: Column) -> Column:
        high_unit = F.regexp_extract(piece, DESC_PRICE, 4)
        low_unit = F.regexp_extract(piece, DESC_PRICE, 2)
        low_unit = F.when(low_unit == "", high_unit).otherwise(low_unit)
        return F.struct(
            (_number(F.regexp_extract(piece, DESC_PRICE, 1)) / _per_crore(low_unit)).alias("min"),
            (_number(F.regexp_extract(piece, DESC_PRICE, 3)) / _per_crore(high_unit)).alias("max"),
        )

    def areas(piece: Column) -> Column:
        ends = [F.replace(F.regexp_extract(piece, DESC_AREA, g), F.lit(","), F.lit("")) for g in (1, 2)]
        return F.struct(ends[0].try_cast("long").alias("min"), ends[1].try_cast("long").alias("max"))

    return F.struct(
        found(DESC_BEDROOMS, rooms).alias("bed"),
        found(DESC_PRICE, prices).alias("price"),
        found(DESC_AREA, areas).alias("area"),
    )


def facing_or_na(c: Column) -> Column:
    """``NA`` where the facing is not given."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("NA"))


def additional_room(c: Column) -> Column:
    """Lower-case room list, ``not available`` where blank."""
    return F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("not available")))
