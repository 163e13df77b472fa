"""Codes, labels and display values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystead.functions.numeric import round_exact

# Code tables of the model columns.
FURNISHING_LABELS = {0: "unfurnished", 1: "semifurnished", 2: "furnished"}
FURNISHING_TITLES = {0: "Unfurnished", 1: "Semi-furnished", 2: "Furnished"}
PROPERTY_TYPE_CODES = {"flat": 0, "house": 1}
LUXURY_CODES = {"Low": 0, "Medium": 1, "High": 2}
FURNISHING_CODES = {"unfurnished": 0, "semifurnished": 1, "furnished": 2}
AGE_GROUPS = {
    "Relatively New": "new",
    "New Property": "new",
    "Moderately Old": "old",
    "Old Property": "old",
    "Under Construction": "under construction",
}

# Prefixes of encoded features and what they are shown as.
READABLE_PREFIXES = [("sector_", "📍 "), ("agePossession_", "🕒 Age: "), ("city_", "🏙 City: ")]


def recode(c: Column, table: dict, default: Column | None = None) -> Column:
    """Replace known codes; any other value becomes ``default``."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    known = F.try_element_at(pairs, c)
    return known if default is None else F.coalesce(known, default)


def log_price(price: Column) -> Column:
    return F.log1p(price)


def price_from_log(value: Column) -> Column:
    return F.expm1(value)


def price_band(price: Column, spread: float = 0.10) -> Column:
    """The range of 10 % around a price."""
    return F.struct(
        round_exact(price * F.lit(1 - spread), 2).alias("low"),
        round_exact(price * F.lit(1 + spread), 2).alias("high"),
    )


def implied_rate(price: Column, area: Column) -> Column:
    """Rupees per square foot, cut to a whole number."""
    return F.try_divide(price * F.lit(1e7), area).cast("long")


def readable_feature(name: Column) -> Column:
    """An encoded feature name for people."""
    shown = F
    for prefix, title in READABLE_PREFIXES:
        shown = shown.when(name.startswith(prefix), F.replace(name, F.lit(prefix), F.lit(title)))
    return shown.otherwise(name)
