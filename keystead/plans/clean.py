"""From raw listing texts to typed listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.functions import text as tx
from keystead.functions.features import area_from_rate
from keystead.operators.quantiles import medians
from keystead.operators.recover import RECOVERED, recover, with_facts
from keystead.operators.rows import first_per_key, has_core_text, is_empty_listing
from keystead.schemas import CLEAN
from keystead.storage import lookup_join, materialise

SOURCE = ["city", "property_type"]
CORE = ["price", "bedRoom", "area"]
STAGE_TEXTS = [
    "property_name", "society", "areaWithType", "balcony", "additionalRoom", "address", "facing",
    "agePossession", "nearbyLocations", "description", "furnishDetails", "features", "rating",
]


def typed_listings(raw: DataFrame) -> DataFrame:
    """Non-empty listings with every field parsed, before de-duplication.

    The description is parsed once; each recovered text goes through the same
    parser as a text that was there from the start.
    """
    df = recover(with_facts(raw).where(has_core_text(F.col("facts"))))
    price = tx.price_to_cr(F.col("price"))
    kind = F.col("property_type")
    return (
        df.withColumns({
            "society": tx.society(F.col("society"), kind),
            "price": price,
            "bedRoom": tx.bedrooms(F.col("bedRoom")),
            "bathroom": tx.first_int(F.col("bathroom")),
            "balcony": tx.balcony(F.col("balcony")),
            "facing": tx.facing_or_na(F.col("facing")),
            "additionalRoom": tx.additional_room(F.col("additionalRoom")),
            "price_per_sqft": tx.rate_per_sqft(F.col("rate")),
            "floorNum": tx.floor_number(F.col("floorNum")),
            "area": tx.area_sqft(F.col("areaWithType")),
        })
        .withColumn("area", F.coalesce("area", area_from_rate(F.col("price"), F.col("price_per_sqft"))))
        .select("property_id", *CLEAN.names)
    )


def deduplicated(typed: DataFrame) -> DataFrame:
    """The first listing of every property id within its source."""
    return first_per_key(typed, [*SOURCE, "property_id"]).select(*typed.columns)


def fill_bathrooms(df: DataFrame) -> DataFrame:
    """Missing bathrooms become the median of their source, 0 if none is known (G1)."""
    usual = medians(df, SOURCE, {"usual": "bathroom"})
    known = lookup_join(df, usual, SOURCE)
    filled = F.coalesce("bathroom", F.col("usual").cast("int"), F.lit(0))
    return known.withColumn("bathroom", filled).select(*df.columns)


def clean(raw: DataFrame) -> DataFrame:
    """Cleaned listings of all sources in ``raw``.

    ``raw`` carries ``listing_id``, ``city`` and ``property_type``; ids are
    compared, and bathrooms filled, within each (city, type) source.
    """
    typed = materialise(typed_listings(raw), "typed")
    return fill_bathrooms(deduplicated(typed).dropna(subset=CORE).select(*CLEAN.names))


def merge(cleaned: DataFrame) -> DataFrame:
    """Cleaned listings as the next stage sees them: missing texts are NULL."""
    return cleaned.withColumns({c: tx.missing_to_null(F.col(c)) for c in STAGE_TEXTS if c in cleaned.columns})


def merge_sources(parts: list[DataFrame]) -> DataFrame:
    """Cleaned tables of several sources as one, columns by name, as the next stage sees them."""
    return merge(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def source_counts(df: DataFrame) -> DataFrame:
    """Rows per city and property type."""
    return df.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("n"))


def repair(raw: DataFrame) -> DataFrame:
    """A raw table with recovered texts, without empty rows and repeated ids."""
    kept = with_facts(raw).where(~is_empty_listing(F.col("facts"), F.col("rate")))
    return first_per_key(materialise(recover(kept).drop("facts"), "repaired"), ["property_id"])


def repair_counts(raw: DataFrame) -> DataFrame:
    """How many fields of each kind the repair fills from descriptions."""
    filled = [
        F.count_if(tx.is_blank(F.col(field)) & F.col("facts")[fact]["min"].isNotNull()).alias(f"filled_{field}")
        for field, fact in RECOVERED.items()
    ]
    return with_facts(raw).agg(*filled)


def clean_funnel(raw: DataFrame) -> DataFrame:
    """Rows read, dropped by each rule and kept, per source."""
    core = has_core_text(F.col("facts"))
    per_source = with_facts(raw).groupBy(*SOURCE).agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(~core).alias("dropped_empty")
    )
    # only what is counted goes through the de-duplication
    counted = materialise(typed_listings(raw).select("listing_id", "property_id", *SOURCE, *CORE), "typed")
    unique = deduplicated(counted).select(*SOURCE, *CORE)
    lacking = F.col("price").isNull() | F.col("bedRoom").isNull() | F.col("area").isNull()
    kept = unique.groupBy(*SOURCE).agg(
        F.count(F.lit(1)).alias("unique_rows"), F.count_if(lacking).alias("dropped_core")
    )
    zero = F.lit(0).cast("long")
    return per_source.join(kept, SOURCE, "left").select(
        *SOURCE,
        "rows_read",
        "dropped_empty",
        (F.col("rows_read") - F.col("dropped_empty") - F.coalesce("unique_rows", zero)).alias("dropped_duplicate"),
        F.coalesce("dropped_core", zero).alias("dropped_core"),
        (F.coalesce("unique_rows", zero) - F.coalesce("dropped_core", zero)).alias("rows_kept"),
    )
