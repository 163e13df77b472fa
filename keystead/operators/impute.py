"""Filling missing built-up areas and ages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.functions.features import UNDEFINED
from keystead.functions.numeric import half_even
from keystead.operators.quantiles import medians
from keystead.storage import lookup_join, materialise

# Limits of the premium check and the usual floor.
PREMIUM_PRICE = 2.5
PREMIUM_MIN_AREA = 2000
USUAL_FLOOR = 2.0
AREA_COLUMNS = ["area", "areaWithType", "super_built_up_area", "carpet_area", "area_room_ratio"]
AGE_PASSES = [["sector", "property_type"], ["sector"], ["property_type"]]


def area_ratios(df: DataFrame) -> DataFrame:
    """One row: median of super and carpet over built-up area, of rows that have all three."""
    built = F.col("built_up_area")
    ratios = df.dropna(subset=["super_built_up_area", "built_up_area", "carpet_area"]).select(
        F.try_divide(F.col("super_built_up_area"), built).alias("of_super"),
        F.try_divide(F.col("carpet_area"), built).alias("of_carpet"),
    )
    return medians(ratios, [], {"r_super": "of_super", "r_carpet": "of_carpet"})


def impute_built_up(df: DataFrame) -> DataFrame:
    """Built-up area from the areas that are known, then the premium check."""
    ratios = area_ratios(df).select(F.struct("r_super", "r_carpet")).scalar()
    from_super = F.col("super_built_up_area") / F.col("ratios.r_super")
    from_carpet = F.col("carpet_area") / F.col("ratios.r_carpet")
    built = F.coalesce(
        F.col("built_up_area"),
        half_even((from_super + from_carpet) / 2),
        half_even(F.when(F.col("carpet_area").isNull(), from_super)),
        half_even(F.when(F.col("super_built_up_area").isNull(), from_carpet)),
    )
    filled = df.withColumn("ratios", ratios).withColumn("built_up_area", built).drop("ratios")
    premium = (F.col("built_up_area") < PREMIUM_MIN_AREA) & (F.col("price") > PREMIUM_PRICE)
    return filled.withColumn(
        "built_up_area",
        F.when(premium, F.coalesce("area", "built_up_area")).otherwise(F.col("built_up_area")),
    )


def group_modes(counts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most frequent value per group of a (keys…, value, n) table, the smallest on ties."""
    per_value = counts.groupBy(*keys, column).agg(F.sum("n").alias("n"))
    return per_value.groupBy(*keys).agg(
        F.min_by(F.col(column), F.struct(-F.col("n"), F.col(column))).alias("mode")
    )


def mode_fill_values(
    df: DataFrame, column: str = "agePossession", sentinel: str = UNDEFINED, passes: list[list[str]] | None = None
) -> DataFrame:
    """What each group's sentinel rows end up with after all passes.

    A pass replaces the sentinel by the mode of the row's group, and the next
    pass counts the replaced values. All of that depends on the counts per
    (group keys, value) only, so the listings are counted once and the passes
    run on the counts.
    """
    passes = AGE_PASSES if passes is None else passes
    keys = sorted({key for keys in passes for key in keys})
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("was", F.col(column)), "age-counts")
    for group in passes:
        modes = group_modes(counts, group, column)
        replaced = F.when(F.col(column) == sentinel, F.coalesce("mode", column)).otherwise(F.col(column))
        counts = materialise(counts.join(modes, group, "left").withColumn(column, replaced).drop("mode"), "age-counts")
    return counts.where(F.col("was") == sentinel).select(*keys, F.col(column).alias("filled"))


def mode_fill(
    df: DataFrame, column: str = "agePossession", sentinel: str = UNDEFINED, passes: list[list[str]] | None = None
) -> DataFrame:
    """Sentinel values replaced by group modes, pass after pass."""
    values = mode_fill_values(df, column, sentinel, passes)
    keys = [c for c in values.columns if c != "filled"]
    joined = lookup_join(df, values, keys)
    filled = F.when(F.col(column) == sentinel, F.coalesce("filled", column)).otherwise(F.col(column))
    return joined.withColumn(column, filled).select(*df.columns)


def impute(df: DataFrame) -> DataFrame:
    """Complete listings: areas inferred, gaps dropped, undefined ages filled."""
    complete = (
        impute_built_up(df)
        .drop(*AREA_COLUMNS, "facing")
        .withColumn("floorNum", F.coalesce("floorNum", F.lit(USUAL_FLOOR)))
        .dropna("any")
    )
    return mode_fill(materialise(complete, "complete"))
