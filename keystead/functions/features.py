"""Features of a listing, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystead.functions.numeric import half_even
from keystead.sources.dims import AMENITY_WEIGHTS

# The labels before the three areas, and square feet in a square metre.
SUPER_BUILT_UP = r"(?U)Super Built up area (\d+\.?\d*)"
BUILT_UP = r"(?U)Built Up area\s*:\s*(\d+\.?\d*)"
CARPET = r"(?U)Carpet area\s*:\s*(\d+\.?\d*)"
PLOT = r"(?U)Plot area (\d+\.?\d*)"
SQFT_PER_SQM = 10.7639

# The room flags looked for in the additional rooms.
ROOM_FLAGS = ["study room", "servant room", "store room", "pooja room", "others"]

# Texts of the age column and the bucket of each, tested in this order.
AGE_BUCKETS = [
    ("New Property", ["0 to 1 Year Old", "Within 6 months", "Within 3 months"]),
    ("Relatively New", ["1 to 5 Year Old"]),
    ("Moderately Old", ["5 to 10 Year Old"]),
    ("Old Property", ["10+ Year Old"]),
    ("Under Construction", ["Under Construction", "By"]),
]
UNDEFINED = "Undefined"


def _group_one(text: Column, pattern: Column) -> Column:
    """First group of a pattern that differs from row to row."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def named_area(text: Column, pattern: str) -> Column:
    """The area after a label, replaced by its square-metre figure where one follows.

    The metric figure counts only if it stands right behind this very number,
    so the number as printed (no superfluous zeros) becomes the pattern.
    """
    # the letters that every match starts with: most texts lack them and need no search
    label = re.match(r"(?:\(\?U\))?([A-Za-z ]*)", pattern)[1][:-1]
    written = F.when(~text.contains(label), F.lit("")).otherwise(F.regexp_extract(text, pattern, 1))
    whole = F.regexp_replace(written, r"^0+(?=\d)", "")
    printed = F.when(
        whole.contains("."), F.regexp_replace(whole, r"\.?0*$", "")
    ).otherwise(whole)
    metric = _group_one(text, F.concat(F.lit("(?U)"), printed, F.lit(r" \((\d+\.?\d*) sq\.m\.\)")))
    value = written.try_cast("double")
    return F.when(
        (written != "") & text.contains("sq.m."),
        F.coalesce(metric.try_cast("double") * F.lit(SQFT_PER_SQM), value),
    ).otherwise(value)


def plot_area(text: Column) -> Column:
    return F.regexp_extract(text, PLOT, 1).try_cast("double")


def fix_scale(area: Column, built: Column) -> Column:
    """Repair a plot area given in gaj or square metres (P20)."""
    ratio = half_even(F.try_divide(area, built))
    return F.when(ratio == 9, built * 9).when(ratio == 11, built * 10.7).otherwise(built)


def room_flag(rooms: Column, flag: str) -> Column:
    """1 if the flag occurs in the room text, else 0."""
    return F.coalesce(rooms.contains(flag), F.lit(False)).cast("int")


def age_bucket(c: Column) -> Column:
    """Age or possession text to one of six buckets."""
    bucket = F
    for name, texts in AGE_BUCKETS:
        found = c.contains(texts[0])
        for text in texts[1:]:
            found = found | c.contains(text)
        bucket = bucket.when(found, F.lit(name))
    ends_in_year = F.rlike(c, F.lit(r"(?U)(^| )\s*[+-]?\d+\s*$"))
    return bucket.when(ends_in_year, F.lit("Under Construction")).otherwise(F.lit(UNDEFINED))


def item_number(text: Column, item: Column) -> Column:
    """The digits before the first numbered mention of an item (``2 Fan``), empty if it has none."""
    quoted = F.concat(F.lit(r"(?U)(\d+) \Q"), item, F.lit(r"\E"))
    return _group_one(text, quoted)


def item_count(text: Column, item: Column) -> Column:
    """How many of an item a furnishing text lists.

    ``No X`` is zero, ``n X`` is n, a bare mention is one. The item is looked
    for anywhere in the text, also inside longer item names.
    """
    number = item_number(text, item).try_cast("int")
    return (
        F.when(F.coalesce(~text.contains(item), F.lit(True)), F.lit(0))
        .when(text.contains(F.concat(F.lit("No "), item)), F.lit(0))
        .otherwise(F.coalesce(number, F.lit(1)))
    )


def furnishing_items(text: Column) -> Column:
    """Item names in a furnishing text, without brackets, counts and ``No``."""
    bare = F.regexp_replace(text, r"[\[\]']", "")
    names = F.transform(
        F.split(bare, ", "), lambda x: F.btrim(F.regexp_replace(x, r"(?U)No |\d+", ""))
    )
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def list_literal(c: Column) -> Column:
    """A list written as text (``['a', "b's"]``) to an array; anything else is empty."""
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    parsed = F.from_json(F.when(c.startswith("["), c), "array<string>", options)
    return F.coalesce(parsed, F.array().cast("array<string>"))


def luxury_score(amenities: Column, weights: dict[str, int] | None = None) -> Column:
    """Sum of the weights of the distinct known amenities."""
    pairs = AMENITY_WEIGHTS if weights is None else weights
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.aggregate(
        F.array_distinct(amenities),
        F.lit(0),
        lambda total, name: total + F.coalesce(F.try_element_at(table, name), F.lit(0)),
    )


def luxury_band(score: Column, low: float = 50, mid: float = 150, high: float = 175) -> Column:
    """Low, Medium or High; a score above ``high`` counts as Low again."""
    return (
        F.when((score >= 0) & (score < low), F.lit("Low"))
        .when((score >= low) & (score < mid), F.lit("Medium"))
        .when(score <= high, F.lit("High"))
        .otherwise(F.lit("Low"))
    )


def floor_band(floor: Column) -> Column:
    """Floors 3-10 are Mid, 11-51 High, everything else Low."""
    return (
        F.when(floor.between(3, 10), F.lit("Mid Floor"))
        .when(floor.between(11, 51), F.lit("High Floor"))
        .otherwise(F.lit("Low Floor"))
    )


def rate(price: Column, area: Column) -> Column:
    """Whole rupees per square foot from crore and square feet."""
    return half_even(F.try_divide(price * F.lit(1e7), area))


def area_from_rate(price: Column, per_sqft: Column) -> Column:
    """Whole square feet from crore and rupees per square foot."""
    return half_even(F.try_divide(price * F.lit(1e7), per_sqft))
