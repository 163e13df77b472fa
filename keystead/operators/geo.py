"""Coordinates of place names by a tiered lookup in a gazetteer.

Tiers, best first: the normalised name is a key; the raw name is a key; a
specific key occurs in the name (longest key, then table order); the name
occurs in a specific key (table order); the centre of the city. A lookup by
the comma-separated pieces of a name would add nothing, because normalising
turns commas into blanks.

"Occurs in" is an equality join on substrings, so that no place is held
against every key: names are cut into all pieces no longer than the longest
key, keys into all their pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.functions.place import normalised_place
from keystead.storage import lookup_join, materialise

EXACT, INSIDE, AROUND = "exact", "inside", "around"


def _pieces(text: Column, longest: Column) -> Column:
    """All distinct substrings of a text up to a length."""
    lengths = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.least(F.length(text), longest)))
    cut = F.transform(
        lengths,
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)),
    )
    return F.array_distinct(F.flatten(cut))


def _key_index(gazetteer: DataFrame) -> DataFrame:
    """Every term that leads to a gazetteer entry, with its way of matching."""
    entry = ["city", "ord", "lat", "lon"]
    specific = gazetteer.where(~F.col("is_generic"))
    exact = gazetteer.select(*entry, F.lit(EXACT).alias("way"), F.col("key").alias("term"), F.lit(0).alias("size"))
    inside = specific.select(*entry, F.lit(INSIDE).alias("way"), F.col("key").alias("term"), F.length("key").alias("size"))
    around = specific.select(
        *entry,
        F.lit(AROUND).alias("way"),
        F.explode(_pieces(F.col("key"), F.length("key"))).alias("term"),
        F.lit(0).alias("size"),
    )
    return exact.unionByName(inside).unionByName(around)


def geo_lookup(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of each distinct (sector, city); NULL for a NULL or empty sector."""
    gazetteer = materialise(gazetteer, "gazetteer")
    named = (
        places.select("sector", "city")
        .distinct()
        .withColumn("name", normalised_place(F.col("sector")))
        .withColumn("given", F.coalesce("city", F.lit("")))
    )
    in_bangalore = F.when(F.col("given") != "", F.col("given") == "bangalore").otherwise(
        F.col("name").contains("bangalore")
    )
    named = materialise(
        named.withColumn("table", F.when(in_bangalore, F.lit("bangalore")).otherwise(F.lit("gurgaon"))), "places"
    )

    def term(tier: int, way: str, text: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(way).alias("way"), text.alias("term"))

    longest = gazetteer.agg(F.max(F.length("key"))).scalar()
    terms = F.concat(
        F.array(
            term(1, EXACT, F.col("name")),
            term(2, EXACT, F.lower("sector")),
            term(4, AROUND, F.col("name")),
        ),
        F.transform(F.coalesce(_pieces(F.col("name"), F.col("longest")), F.array()), lambda t: term(3, INSIDE, t)),
    )
    wanted = (
        named.where(F.col("sector") != "")
        .withColumn("longest", longest)
        .select("sector", "given", "table", F.explode(terms).alias("t"))
        .select("sector", "given", F.col("table").alias("city"), "t.*")
    )
    best = F.min(F.struct("tier", (-F.col("size")).alias("by"), "ord", "lat", "lon")).alias("best")
    found = lookup_join(wanted, _key_index(gazetteer), ["city", "way", "term"], "inner").groupBy("sector", "given").agg(best)
    centres = gazetteer.where("is_centre").select(F.col("city").alias("table"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    known = F.col("sector") != ""
    return (
        named.join(found, ["sector", "given"], "left")
        .join(centres, "table", "left")
        .select(
            "sector",
            "city",
            F.when(known, F.coalesce("best.lat", "clat")).alias("lat"),
            F.when(known, F.coalesce("best.lon", "clon")).alias("lon"),
        )
    )


def add_coords(df: DataFrame, gazetteer: DataFrame, sector_col: str = "sector", city_col: str = "city") -> DataFrame:
    """Adds ``lat`` and ``lon``; the lookup runs once per distinct place."""
    city = F.col(city_col) if city_col in df.columns else F.lit(None).cast("string")
    places = df.select(F.col(sector_col).alias("sector"), city.alias("city"))
    coords = geo_lookup(places, gazetteer).select(
        F.col("sector").alias("at_sector"), F.coalesce("city", F.lit("")).alias("at_city"), "lat", "lon"
    )
    keyed = df.withColumns({"at_sector": F.col(sector_col), "at_city": F.coalesce(city, F.lit(""))})
    return lookup_join(keyed, coords, ["at_sector", "at_city"]).drop("at_sector", "at_city")


def sector_cities(df: DataFrame) -> DataFrame:
    """City of each sector: Bangalore if named so or listed there, else Gurgaon."""
    listed = F.bool_or(F.col("city") == "bangalore")
    return df.groupBy("sector").agg(listed.alias("listed")).select(
        "sector",
        F.when(F.col("listed") | F.lower("sector").contains("bangalore"), F.lit("bangalore"))
        .otherwise(F.lit("gurgaon"))
        .alias("city"),
    )
