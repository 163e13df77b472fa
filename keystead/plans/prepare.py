"""From cleaned listings to the model-ready table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.functions import features as ft
from keystead.functions.place import apply_aliases, sector_text
from keystead.operators.furnish import furnishing_levels
from keystead.operators.impute import impute
from keystead.operators.outliers import treat_outliers
from keystead.operators.rows import frequent_groups
from keystead.plans.clean import CORE, deduplicated, fill_bathrooms, merge, typed_listings
from keystead.schemas import FINAL_COLUMNS
from keystead.storage import lookup_join, materialise

LOCATED_DROPS = ["property_name", "address", "description", "rating"]
TEXT_DROPS = ["nearbyLocations", "furnishDetails", "features", "additionalRoom"]


def with_sector(df: DataFrame, aliases: list[tuple[str, str]] | None = None, strip_trailing_comma: bool = False) -> DataFrame:
    """Adds ``sector``, the normalised place of the listing title."""
    return df.withColumn("sector", apply_aliases(sector_text(F.col("property_name"), strip_trailing_comma), aliases))


def locate(df: DataFrame, aliases: list[tuple[str, str]] | None = None, min_count: int = 3) -> DataFrame:
    """Located listings of sectors with at least ``min_count`` of them."""
    # a title without a place is told before the aliases; sectors are counted by distinct titles
    titled = df.where(sector_text(F.col("property_name")).isNotNull())
    located = with_sector(titled, aliases).drop(*LOCATED_DROPS)
    names = with_sector(titled.groupBy("property_name").agg(F.count(F.lit(1)).alias("n")), aliases)
    frequent = names.groupBy("sector").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return lookup_join(located, frequent.select("sector"), ["sector"], "left_semi").select(*located.columns)


def with_areas(df: DataFrame) -> DataFrame:
    """Adds super built-up, built-up and carpet area; a plot area stands in if all lack."""
    text = F.col("areaWithType")
    named = df.withColumns({
        "super_built_up_area": ft.named_area(text, ft.SUPER_BUILT_UP),
        "built_up_area": ft.named_area(text, ft.BUILT_UP),
        "carpet_area": ft.named_area(text, ft.CARPET),
    })
    known = F.coalesce("super_built_up_area", "built_up_area", "carpet_area")
    plot = ft.fix_scale(F.col("area"), ft.plot_area(text))
    return named.withColumn("built_up_area", F.when(known.isNull(), plot).otherwise(F.col("built_up_area")))


def with_room_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({flag: ft.room_flag(F.col("additionalRoom"), flag) for flag in ft.ROOM_FLAGS})


def featurise_texts(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """All features that come from the row alone."""
    return with_room_flags(with_areas(df)).withColumns({
        "agePossession": ft.age_bucket(F.col("agePossession")),
        "luxury_score": ft.luxury_score(ft.list_literal(F.col("features")), weights),
    })


def featurise(df: DataFrame, weights: dict[str, int] | None = None, k: int = 3, seed: int = 42) -> DataFrame:
    """Numeric and categorical features instead of the texts."""
    return furnishing_levels(featurise_texts(df, weights), k, seed).drop(*TEXT_DROPS)


def select_final(df: DataFrame) -> DataFrame:
    """The 14 model columns behind the listing id."""
    banded = df.withColumns({
        "luxury_category": ft.luxury_band(F.col("luxury_score")),
        "floor_category": ft.floor_band(F.col("floorNum")),
    })
    return banded.select("listing_id", *[c for c in FINAL_COLUMNS if c in banded.columns])


def row_features(typed: DataFrame, aliases: list[tuple[str, str]] | None = None, weights: dict[str, int] | None = None) -> DataFrame:
    """Everything that a listing's own row determines, without the texts it came from."""
    located = with_sector(merge(typed), aliases)
    done = {*LOCATED_DROPS, *TEXT_DROPS} - {"furnishDetails"}
    return featurise_texts(located, weights).drop(*done)


def prepare(
    raw: DataFrame,
    aliases: list[tuple[str, str]] | None = None,
    weights: dict[str, int] | None = None,
    corrections: DataFrame | None = None,
    bad_rows: DataFrame | None = None,
    min_count: int = 3,
) -> DataFrame:
    """The whole way from raw texts to the model-ready table.

    Same result as the stages one after the other. All work on single rows
    comes before the first shuffle, so that long texts are never shuffled or
    written; rows are written where a stage needs a statistic of the very rows
    it then changes.
    """
    typed = materialise(row_features(typed_listings(raw), aliases, weights), "typed")
    kept = deduplicated(typed).dropna(subset=CORE).drop("property_id")
    filled = fill_bathrooms(kept).where(F.col("sector").isNotNull())
    frequent = frequent_groups(filled, "sector", min_count)
    featured = furnishing_levels(frequent).drop("furnishDetails")
    treated = materialise(treat_outliers(featured, corrections, bad_rows), "treated")
    return select_final(impute(treated))


def stage_funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows left after each stage, in stage order."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "n_rows")
        for i, (name, df) in enumerate(stages.items())
    ]
    return reduce(DataFrame.unionByName, parts)
