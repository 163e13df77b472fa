"""Filling blank listing fields from the description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.functions.text import description_facts, is_blank


RECOVERED = {"bedRoom": "bed", "price": "price", "areaWithType": "area"}


def with_facts(raw: DataFrame) -> DataFrame:
    """Adds ``facts``, the ranges stated in the description.

    Descriptions are searched only where one of the three fields is blank.
    """
    incomplete = reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in RECOVERED])
    return raw.withColumn("facts", F.when(incomplete, description_facts(F.col("description"))))


def _plain(c: Column) -> Column:
    """A number as text, never in exponent form."""
    exponent = (c != 0) & ((F.abs(c) < 1e-3) | (F.abs(c) >= 1e7))
    fixed = F.regexp_replace(F.format_string("%.20f", c), r"(\.\d*?)0+$", "$1")
    return F.when(exponent, fixed).otherwise(c.cast("string"))


def recovered_texts(facts: Column) -> dict[str, Column]:
    """The three fields as listing text, NULL where the description is silent."""
    rooms = F.when(
        facts["bed"]["min"] == facts["bed"]["max"], F.concat(facts["bed"]["min"].cast("string"), F.lit(" Bedrooms"))
    ).otherwise(
        F.concat(facts["bed"]["min"].cast("string"), F.lit("-"), facts["bed"]["max"].cast("string"), F.lit(" BHK"))
    )
    price = F.concat(F.lit("₹ "), _plain(facts["price"]["min"]), F.lit(" - "), _plain(facts["price"]["max"]), F.lit(" Cr"))
    area = F.concat(
        F.format_number(facts["area"]["min"], 0), F.lit(" - "), F.format_number(facts["area"]["max"], 0), F.lit(" sqft")
    )
    return {"bedRoom": rooms, "price": price, "areaWithType": area}


def recover(raw: DataFrame) -> DataFrame:
    """Blank bedroom, price and area texts filled from the description (P10)."""
    df = raw if "facts" in raw.columns else with_facts(raw)
    texts = recovered_texts(F.col("facts"))
    filled = {
        name: F.when(is_blank(F.col(name)), F.coalesce(text, F.col(name))).otherwise(F.col(name))
        for name, text in texts.items()
    }
    return df.withColumns(filled)
