"""Market views over the model-ready table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystead.functions.features import rate
from keystead.functions.labels import FURNISHING_TITLES, recode
from keystead.functions.numeric import round_scaled
from keystead.operators.geo import add_coords, sector_cities
from keystead.operators.quantiles import medians
from keystead.operators.rows import select_listings
from keystead.storage import materialise

SECTOR_METRICS = ["median_price", "price_per_sqft", "listings", "median_area"]
LUXURY_ORDER = ["Low", "Medium", "High"]


def city_comparison(df: DataFrame) -> DataFrame:
    """Listings, price range and median area per city."""
    counts = df.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_properties"),
        F.count_if(F.col("property_type") == "flat").alias("flats"),
        F.count_if(F.col("property_type") == "house").alias("houses"),
        round_scaled(F.min("price"), 2).alias("price_min_cr"),
        round_scaled(F.max("price"), 2).alias("price_max_cr"),
        F.countDistinct("sector").alias("unique_locations"),
    )
    mid = medians(df, ["city"], {"price": "price", "area": "built_up_area"})
    return counts.join(mid, "city", "left").select(
        *counts.columns,
        round_scaled(F.col("price"), 2).alias("price_median_cr"),
        F.col("area").cast("long").alias("area_median_sqft"),
    )


def city_wide(df: DataFrame) -> DataFrame:
    """City comparison with mean price and median rate."""
    counts = df.groupBy("city").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("property_type") == "flat").alias("flats"),
        F.count_if(F.col("property_type") == "house").alias("houses"),
        round_scaled(F.avg("price"), 2).alias("mean_price"),
        F.countDistinct("sector").alias("locations"),
    )
    mid = medians(df, ["city"], {"price": "price", "area": "built_up_area"})
    return counts.join(mid, "city", "left").select(
        *counts.columns,
        round_scaled(F.col("price"), 2).alias("median_price"),
        F.col("area").cast("long").alias("median_sqft"),
        F.try_divide(F.col("price") * F.lit(1e7), F.col("area")).cast("long").alias("median_rate"),
    )


def sector_stats(df: DataFrame, at_least: int = 3) -> DataFrame:
    """Price and area statistics of every sector with enough listings."""
    counts = df.groupBy("sector").agg(
        F.count("price").alias("listings"), F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )
    mid = medians(df, ["sector"], {"median_price": "price", "median_area": "built_up_area"})
    per_sqft = rate(F.col("median_price"), F.col("median_area")).cast("long")
    joined = counts.where(F.col("listings") >= at_least).join(mid, "sector")
    return joined.withColumn("price_per_sqft", per_sqft)


def rank_sectors(stats: DataFrame, metric: str = "median_price", n: int = 12) -> DataFrame:
    """The top sectors by one metric."""
    if metric not in SECTOR_METRICS:
        raise ValueError(f"metric must be one of {SECTOR_METRICS}")
    return stats.orderBy(F.desc(metric), "sector").limit(n)


def cheapest_priciest(stats: DataFrame, n: int = 5) -> DataFrame:
    """The n cheapest and n priciest sectors by median price."""
    stats = materialise(stats, "sector-stats")

    def side(name: str, order: Column) -> DataFrame:
        top = stats.orderBy(order, "sector").limit(n)
        place = F.row_number().over(Window.orderBy(order, "sector"))
        return top.select(
            F.lit(name).alias("side"),
            place.alias("place"),
            "sector",
            "listings",
            round_scaled(F.col("median_price"), 2).alias("median_price"),
        )

    return side("cheapest", F.asc("median_price")).unionByName(side("priciest", F.desc("median_price")))


def sector_profile(df: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Listings, medians and rate of every sector, with its city."""
    counts = df.groupBy("sector").agg(F.count("price").alias("n"))
    mid = medians(df, ["sector"], {"price": "price", "area": "built_up_area"})
    cities = sector_cities(df if master is None else master)
    return (
        counts.join(mid, "sector", "left")
        .join(cities, "sector", "left")
        .withColumn("price_per_sqft", rate(F.col("price"), F.col("area")))
    )


def marker_style(df: DataFrame, metric: str) -> DataFrame:
    """Marker size 50-300 and a blue-to-red colour by one metric."""
    df = materialise(df, "markers")
    bounds = df.agg(F.struct(F.min(metric).cast("double").alias("low"), F.max(metric).cast("double").alias("high")))
    scaled = df.withColumn("bounds", bounds.scalar()).withColumn(
        "share",
        (F.col(metric) - F.col("bounds.low")) / (F.col("bounds.high") - F.col("bounds.low") + F.lit(1e-9)),
    )
    return scaled.withColumns({
        "size": (F.col("share") * 250 + 50).cast("int"),
        "red": (F.col("share") * 255).cast("int"),
        "blue": ((1 - F.col("share")) * 255).cast("int"),
    }).drop("bounds", "share")


def sector_map(df: DataFrame, gazetteer: DataFrame, metric: str = "price", max_points: int | None = None) -> DataFrame:
    """Sectors with coordinates, marker size and colour; the first ``max_points`` if given."""
    placed = add_coords(sector_profile(df), gazetteer).dropna(subset=["lat", "lon"])
    if max_points is not None:
        placed = placed.orderBy("sector").limit(max_points)
    return marker_style(placed, metric)


def map_centre(points: DataFrame) -> DataFrame:
    """Median latitude and longitude."""
    return medians(points, [], {"lat": "lat", "lon": "lon"})


def market_compare(df: DataFrame, price: float, city: str, property_type: str, bedrooms: int) -> DataFrame:
    """One row: a price against the listings of its segment."""
    similar = select_listings(df, city=city, property_type=property_type, bedrooms=bedrooms)
    overall = similar.agg(F.count(F.lit(1)).alias("listings"), F.min("price").alias("market_low"), F.max("price").alias("market_high"))
    mid = medians(similar, [], {"m": "price"}).scalar()
    row = overall.withColumn("market_median", mid)
    diff = F.lit(price) - F.col("market_median")
    percent = diff / F.col("market_median") * 100
    verdict = (
        F.when(F.abs(percent) < 5, F.lit("at the median"))
        .when(diff > 0, F.lit("above"))
        .when(diff <= 0, F.lit("below"))
    )
    return row.select("*", diff.alias("difference"), percent.alias("percent"), verdict.alias("verdict"))


def kpi(df: DataFrame) -> DataFrame:
    """Listings, median price and locations of a slice."""
    counts = df.agg(F.count(F.lit(1)).alias("properties"), F.countDistinct("sector").alias("locations"))
    return counts.withColumn("median_price", medians(df, [], {"m": "price"}).scalar())


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins, closed on the right; the smallest value is in bin 0, empty bins stay."""
    x = F.col(column)
    known = df.where(x.isNotNull() & ~F.isnan(x)).select(x.cast("double").alias("x"))
    ends = known.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("e"))
    flat = F.col("e.low") == F.col("e.high")
    # A single value gets a range of 0.1 % around it.
    margin = F.when(flat, F.when(F.col("e.low") != 0, F.abs("e.low") * 0.001).otherwise(F.lit(0.001))).otherwise(F.lit(0.0))
    ends = ends.select((F.col("e.low") - margin).alias("low"), (F.col("e.high") + margin).alias("high"), flat.alias("flat"))
    ends = materialise(ends, "ends")
    low, high = ends.select("low").scalar(), ends.select("high").scalar()

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("high")).otherwise(F.col("low") + i * F.col("width"))

    framed = known.withColumns({"low": low, "high": high}).withColumn("width", (F.col("high") - F.col("low")) / bins)
    guess = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("x") - F.col("low")) / F.col("width")))).cast("int")
    # The division may be off by one place at an edge; the edges decide.
    upper = F.when(F.col("x") > edge(F.col("guess")), F.col("guess") + 1).when(
        (F.col("guess") > 1) & (F.col("x") <= edge(F.col("guess") - 1)), F.col("guess") - 1
    ).otherwise(F.col("guess"))
    counted = framed.withColumn("guess", guess).groupBy((upper - 1).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumns({
        "low": low, "high": high, "flat": ends.select("flat").scalar(),
    }).withColumn("width", (F.col("high") - F.col("low")) / bins)
    left = F.when(
        (F.col("bin") == 0) & ~F.col("flat"), F.col("low") - (F.col("high") - F.col("low")) * 0.001
    ).otherwise(edge(F.col("bin")))
    return frame.join(counted, "bin", "left").select(
        "bin", left.alias("left"), edge(F.col("bin") + 1).alias("right"), F.coalesce("count", F.lit(0).cast("long")).alias("count")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column)


def furnishing_counts(df: DataFrame) -> DataFrame:
    """Rows per furnishing level by its title."""
    title = recode(F.col("furnishing_type"), FURNISHING_TITLES, F.col("furnishing_type").cast("string"))
    return value_counts(df.select(title.alias("furnishing")), "furnishing")


def luxury_counts(df: DataFrame) -> DataFrame:
    """Rows per luxury level, in fixed order and with 0 for an absent one."""
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias("luxury_category")) for i, v in enumerate(LUXURY_ORDER)]))
    frame = df.sparkSession.range(1).select(levels.alias("l")).select("l.*")
    return (
        frame.join(value_counts(df, "luxury_category"), "luxury_category", "left")
        .select("luxury_category", F.coalesce("count", F.lit(0).cast("long")).alias("count"), "ord")
        .orderBy("ord")
        .drop("ord")
    )


def distinct_values(df: DataFrame, column: str, city: str | None = None) -> DataFrame:
    """Sorted distinct values, of one city if given."""
    return select_listings(df, city=city).select(column).distinct().orderBy(column)


def median_price_pivot(df: DataFrame, row: str, cities: list[str], levels: list[str] | None = None) -> DataFrame:
    """Median price by one column × city.

    A combination without listings is 0. If ``levels`` are given, exactly these
    rows come out, and a level without any listing is NULL.
    """
    mid = medians(df, [row, "city"], {"price": "price"}).withColumn("price", round_scaled(F.col("price"), 2))
    wide = mid.groupBy(row).pivot("city", cities).agg(F.first("price")).na.fill(0.0, cities)
    if levels is None:
        return wide
    frame = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in levels])).alias(row))
    return frame.join(wide, row, "left")


def count_pivot(df: DataFrame, row: str, cities: list[str]) -> DataFrame:
    """Listings by one column × city."""
    return df.groupBy(row).pivot("city", cities).count().na.fill(0, cities)


def result_summary(results: DataFrame) -> DataFrame:
    """Matches, best and mean score of a recommendation."""
    return results.agg(
        F.count(F.lit(1)).alias("matches"), F.max("SimilarityScore").alias("top_score"), F.avg("SimilarityScore").alias("avg_score")
    )


def score_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean and population deviation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x")) for c in columns]))
    return (
        df.select(pairs.alias("p"))
        .groupBy(F.col("p.column").alias("column"))
        .agg(F.avg("p.x").alias("mean"), F.stddev_pop("p.x").alias("std"))
    )
