"""Outlier treatment of featured listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.functions.features import rate
from keystead.operators.quantiles import quantiles
from keystead.operators.rows import distinct_rows, reject_rows
from keystead.storage import lookup_join, materialise

# Limits of a believable listing.
MAX_RATE = 50_000
MAX_AREA = 100_000
MAX_BEDROOMS = 10
SMALL_AREA = 1000
SMALL_AREA_FACTOR = 9


def iqr_limit(df: DataFrame, column: str = "price_per_sqft", k: float = 1.5) -> DataFrame:
    """One row: quartiles of a column and the limit Q3 + k·IQR."""
    found = quantiles(df, [], {"q1": (column, 0.25), "q3": (column, 0.75)})
    return found.withColumn("upper", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1")))


def fix_rate_scale(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Rows above the rate limit: a small area is taken as square yards, the rate is recomputed."""
    upper = iqr_limit(df, k=k).select("upper").scalar()
    flagged = df.withColumn("is_outlier", F.coalesce(F.col("price_per_sqft") > upper, F.lit(False)))
    area = F.when(F.col("area") < SMALL_AREA, F.col("area") * SMALL_AREA_FACTOR).otherwise(F.col("area"))
    fixed = flagged.withColumn("area", F.when(F.col("is_outlier"), area).otherwise(F.col("area")))
    recomputed = F.coalesce(rate(F.col("price"), F.col("area")), F.col("price_per_sqft"))
    return fixed.withColumn(
        "price_per_sqft", F.when(F.col("is_outlier"), recomputed).otherwise(F.col("price_per_sqft"))
    ).drop("is_outlier")


def apply_corrections(df: DataFrame, corrections: DataFrame, columns: list[str], key: str = "listing_id") -> DataFrame:
    """Listed values override the row's own.

    ``corrections`` has one row per (key, column, value); ``columns`` are the
    numeric columns it may correct.
    """
    new = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"new {c}") for c in columns]
    wide = corrections.groupBy(key).agg(*new)
    joined = lookup_join(df, wide, [key])
    values = {c: F.coalesce(F.col(f"new {c}"), F.col(c)) for c in columns}
    return joined.withColumns(values).select(*df.columns)


def treat_outliers(
    df: DataFrame,
    corrections: DataFrame | None = None,
    bad_rows: DataFrame | None = None,
    k: float = 1.5,
) -> DataFrame:
    """Repaired, capped and corrected listings with rate and area per room.

    The quartiles come from all distinct rows, before any row is dropped.
    """
    rows = fix_rate_scale(materialise(distinct_rows(df), "distinct"), k)
    rows = rows.where((F.col("price_per_sqft") <= MAX_RATE) & (F.col("area") < MAX_AREA))
    if bad_rows is not None:
        rows = reject_rows(rows, bad_rows)
    if corrections is not None:
        rows = apply_corrections(rows, corrections, ["area", "carpet_area"])
    return rows.where(F.col("bedRoom") <= MAX_BEDROOMS).withColumns({
        "price_per_sqft": rate(F.col("price"), F.col("area")),
        "area_room_ratio": F.try_divide("area", "bedRoom"),
    })
