"""Every registered query: a Spark callable and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystead.functions import features as ft
from keystead.functions import labels as lb
from keystead.functions import place as pl
from keystead.functions import text as tx
from keystead.operators import furnish, geo, impute, market, outliers, pages, recover, rows, similar
from keystead.plans import clean, drivers, encode, prepare, price, store
from keystead.schemas import FINAL as FINAL_SCHEMA
from keystead.sources.dims import gazetteer
from keystead.sources.keyed_sink import append_keyed, read_keyed
from keystead.sources.order_listings import raw_listings, raw_listings_of
from keystead.sources.order_pages import ORDER_PAGES_SQL, order_pages
from keystead.sources.tables import (
    append_by_city_and_kind,
    read_pages,
    read_sources,
    read_stage,
    stored_keys,
    unseen,
    write_by_city_and_kind,
    write_stage,
)
from keystead.storage import delete, materialise, new_path
from keystead.streaming import ingest
from oracle import listings as sql
from oracle.listings import GAZETTEER, over, q

Query = Callable[[SparkSession, str], DataFrame]
CITIES = ["bangalore", "gurgaon"]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_stages: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        _queries[name] = fn
        if oracle is not None:
            _sql[name] = oracle
        return fn

    return add


# ---------------------------------------------------------------- shared stages

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "merged": lambda s, d: clean.merge(clean.clean(raw_listings(s, d))),
    "located": lambda s, d: prepare.locate(stage(s, d, "merged")),
    "featured": lambda s, d: prepare.featurise_texts(stage(s, d, "located")),
    "treated": lambda s, d: outliers.treat_outliers(stage(s, d, "featured").drop(*prepare.TEXT_DROPS)),
    "final": lambda s, d: prepare.prepare(raw_listings(s, d)),
    "ruled": lambda s, d: _with_bands(s, d),
}


def stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stage table over the whole input, written once per session.

    The market and model queries read the prepared table, as an application
    would; the queries named after a stage build it themselves.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _stages:
        _stages[key] = materialise(BUILDERS[name](spark, folder), name)
    return _stages[key]


def final(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "final")


def ruled(spark: SparkSession, folder: str) -> DataFrame:
    """The final table with furnishing levels by the number of items instead of clusters."""
    return stage(spark, folder, "ruled")


def _with_bands(spark: SparkSession, folder: str) -> DataFrame:
    bands_ = stage(spark, folder, "merged").select("listing_id", furnish.furnishing_band(F.col("furnishDetails")).alias("furnishing_type"))
    return final(spark, folder).drop("furnishing_type").join(bands_, "listing_id")


def r6(c) -> F.Column:
    return F.rint(c * 1e6) / 1e6


def s6(expr: str) -> str:
    return f"round_even(({expr}) * 1e6, 0) / 1e6"


# ---------------------------------------------------------------- text fields


@query("parse_price", over("raw", f"SELECT listing_id, {sql.price_cr('price')} AS price_cr FROM raw"))
def parse_price(spark, folder):
    return raw_listings(spark, folder).select("listing_id", tx.price_to_cr(F.col("price")).alias("price_cr"))


@query("parse_bedroom", over("raw", f"SELECT listing_id, {sql.bedrooms('bedRoom')} AS bedrooms FROM raw"))
def parse_bedroom(spark, folder):
    return raw_listings(spark, folder).select("listing_id", tx.bedrooms(F.col("bedRoom")).alias("bedrooms"))


@query("parse_area", over("raw", f"SELECT listing_id, {sql.area_sqft('areaWithType')} AS area FROM raw"))
def parse_area(spark, folder):
    return raw_listings(spark, folder).select("listing_id", tx.area_sqft(F.col("areaWithType")).alias("area"))


@query(
    "parse_description",
    over("facts", f"SELECT listing_id, bed_min, bed_max, {s6('price_min')} AS price_min, {s6('price_max')} AS price_max, area_min, area_max FROM facts"),
)
def parse_description(spark, folder):
    facts = tx.description_facts(F.col("description"))
    ends = raw_listings(spark, folder).select("listing_id", facts.alias("facts")).select(
        "listing_id", *[F.col("facts")[fact][end].alias(f"{fact}_{end}") for fact in ("bed", "price", "area") for end in ("min", "max")]
    )
    return ends.withColumns({"price_min": r6(F.col("price_min")), "price_max": r6(F.col("price_max"))})


@query("recover", over("recovered", "SELECT listing_id, bedRoom, price, areaWithType FROM recovered"))
def recover_fields(spark, folder):
    return recover.recover(raw_listings(spark, folder)).select("listing_id", "bedRoom", "price", "areaWithType")


@query(
    "text_fields",
    over(
        "raw",
        f"""SELECT listing_id, {sql.first_int('bathroom')} AS bathroom, {sql.balcony('balcony')} AS balcony, {sql.floor_number('floorNum')} AS floor,
        {sql.society('society', 'property_type')} AS society, {sql.rate_per_sqft('rate')} AS rate,
        CASE WHEN facing = '' THEN 'NA' ELSE facing END AS facing,
        lower(CASE WHEN additionalRoom = '' THEN 'not available' ELSE additionalRoom END) AS additional_room FROM raw""",
    ),
)
def text_fields(spark, folder):
    return raw_listings(spark, folder).select(
        "listing_id",
        tx.first_int(F.col("bathroom")).alias("bathroom"),
        tx.balcony(F.col("balcony")).alias("balcony"),
        tx.floor_number(F.col("floorNum")).alias("floor"),
        tx.society(F.col("society"), F.col("property_type")).alias("society"),
        tx.rate_per_sqft(F.col("rate")).alias("rate"),
        tx.facing_or_na(F.col("facing")).alias("facing"),
        tx.additional_room(F.col("additionalRoom")).alias("additional_room"),
    )


# ---------------------------------------------------------------- cleaning


@query(
    "clean_funnel",
    over(
        "deduped",
        """SELECT city, property_type, count(*) AS rows_read, count(*) - any_value(t) AS dropped_empty, any_value(t) - any_value(u) AS dropped_duplicate,
        any_value(u) - any_value(k) AS dropped_core, any_value(k) AS rows_kept FROM raw
        JOIN (SELECT city, property_type, count(*) AS t FROM typed GROUP BY ALL) USING (city, property_type)
        JOIN (SELECT city, property_type, count(*) AS u, count(*) FILTER (WHERE price IS NOT NULL AND bedRoom IS NOT NULL AND area IS NOT NULL) AS k
              FROM deduped GROUP BY ALL) USING (city, property_type) GROUP BY city, property_type""",
    ),
)
def clean_funnel(spark, folder):
    return clean.clean_funnel(raw_listings(spark, folder))


@query(
    "dedup_first",
    over("raw", "SELECT property_id, min(listing_id) AS listing_id, arg_min(property_name, listing_id) AS property_name, arg_min(description, listing_id) AS description FROM raw GROUP BY property_id"),
)
def dedup_first(spark, folder):
    raw = raw_listings(spark, folder).select("listing_id", "property_id", "property_name", "description")
    return rows.first_per_key(raw, ["property_id"])


@query("clean_listings", over("cleaned", f"SELECT {sql.CLEAN_COLUMNS} FROM cleaned"))
def clean_listings(spark, folder):
    return clean.clean(raw_listings(spark, folder)).select(*sql.CLEAN_COLUMNS.split(", "))


@query("source_counts", over("cleaned", "SELECT city, property_type, count(*) AS n FROM cleaned GROUP BY ALL"))
def source_counts(spark, folder):
    return clean.source_counts(stage(spark, folder, "merged"))


@query("merge_sources", over("merged", f"SELECT {sql.CLEAN_COLUMNS} FROM merged"))
def merge_sources(spark, folder):
    return stage(spark, folder, "merged").select(*sql.CLEAN_COLUMNS.split(", "))


REPAIRED = "property_id, listing_id, city, property_type, property_name, society, price, rate, bedRoom, areaWithType, bathroom"


@query(
    "repair_table",
    over(
        "recovered",
        f"""SELECT {REPAIRED} FROM recovered
        WHERE NOT (trim(price) = '' AND trim(bedRoom) = '' AND trim(areaWithType) = '' AND trim(rate) = '' AND bed_min IS NULL AND price_min IS NULL AND area_min IS NULL)
        QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY listing_id) = 1""",
    ),
)
def repair_table(spark, folder):
    return clean.repair(raw_listings(spark, folder)).select(*REPAIRED.split(", "))


@query(
    "repair_counts",
    over(
        "facts",
        """SELECT count(*) FILTER (WHERE trim(bedRoom) = '' AND bed_min IS NOT NULL) AS "filled_bedRoom",
        count(*) FILTER (WHERE trim(price) = '' AND price_min IS NOT NULL) AS filled_price,
        count(*) FILTER (WHERE trim(areaWithType) = '' AND area_min IS NOT NULL) AS "filled_areaWithType" FROM facts""",
    ),
)
def repair_counts(spark, folder):
    return clean.repair_counts(raw_listings(spark, folder))


# ---------------------------------------------------------------- places


@query(
    "extract_sector",
    over("raw", f"SELECT listing_id, lower(trim(replace(string_split(property_name, 'in')[2], 'Gurgaon', ''))) AS place, {sql.sector('property_name')} AS sector FROM raw"),
)
def extract_sector(spark, folder):
    name = F.col("property_name")
    return raw_listings(spark, folder).select(
        "listing_id", pl.sector_text(name).alias("place"), pl.apply_aliases(pl.sector_text(name)).alias("sector")
    )


@query("short_place", over("raw", f"SELECT listing_id, trim(string_split({sql.sector('property_name')}, ',')[1]) AS place FROM raw"))
def short_place(spark, folder):
    sector = pl.apply_aliases(pl.sector_text(F.col("property_name")))
    return raw_listings(spark, folder).select("listing_id", pl.first_comma_piece(sector).alias("place"))


@query(
    "city_names",
    over("raw", """SELECT listing_id, city, CASE WHEN contains(lower(property_name), 'bangalore') THEN 'bangalore' ELSE 'gurgaon' END AS told,
      lower(n_name) AS slug FROM raw JOIN orders ON o_orderkey = listing_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""),
)
def city_names(spark, folder):
    orders, customer, nation = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "customer", "nation"))
    alias = F.regexp_replace(F.initcap("city"), "Bangalore", "Bengaluru")
    named = raw_listings(spark, folder).select(
        "listing_id", pl.city_slug(F.replace(alias, F.lit("Gurgaon"), F.lit("Gurugram"))).alias("city"), pl.city_of(F.col("property_name")).alias("told")
    )
    slugs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.join(slugs.select(F.col("o_orderkey").alias("listing_id"), pl.city_slug(F.col("n_name")).alias("slug")), "listing_id")


@query(
    "frequent_sectors",
    over("sectored", "SELECT listing_id, city, sector FROM sectored WHERE sector IN (SELECT sector FROM sectored GROUP BY sector HAVING count(*) >= 3)"),
)
def frequent_sectors(spark, folder):
    return prepare.locate(stage(spark, folder, "merged")).select("listing_id", "city", "sector")


GEO_SQL = f"""
gaz AS (SELECT city, ord, key, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, generic FROM {GAZETTEER}),
places AS (SELECT DISTINCT sector, city, trim(regexp_replace(lower(sector), '[^a-z0-9 ]', ' ', 'g')) AS s FROM sectored WHERE sector IS NOT NULL),
cand AS (
  SELECT sector, places.city, 1 AS tier, 0 AS shorter, ord, lat, lon FROM places JOIN gaz ON gaz.city = places.city AND key = s
  UNION ALL SELECT sector, places.city, 2, 0, ord, lat, lon FROM places JOIN gaz ON gaz.city = places.city AND key = lower(sector)
  UNION ALL SELECT sector, places.city, 5, -length(key), ord, lat, lon FROM places JOIN gaz ON gaz.city = places.city AND NOT generic AND contains(s, key)
  UNION ALL SELECT sector, places.city, 6, 0, ord, lat, lon FROM places JOIN gaz ON gaz.city = places.city AND NOT generic AND s <> '' AND contains(key, s)
  UNION ALL SELECT sector, places.city, 7, 0, ord, lat, lon FROM places JOIN gaz ON gaz.city = places.city AND key = CASE WHEN places.city = 'bangalore' THEN 'bangalore' ELSE 'new' END),
coords AS (SELECT sector, city, lat, lon FROM cand QUALIFY row_number() OVER (PARTITION BY sector, city ORDER BY tier, shorter, ord) = 1)
"""


def geo_over(stage_name: str, select: str) -> str:
    return over(stage_name, "").rstrip() + "," + GEO_SQL + select


@query("geo_lookup", geo_over("sectored", "SELECT sector, city, lat, lon FROM coords"))
def geo_lookup(spark, folder):
    places = prepare.with_sector(stage(spark, folder, "merged")).where(F.col("sector").isNotNull())
    return geo.geo_lookup(places, gazetteer(spark))


@query("add_coords", geo_over("sectored", "SELECT listing_id, sector, city, lat, lon FROM sectored LEFT JOIN coords USING (sector, city)"))
def add_coords(spark, folder):
    located = prepare.with_sector(stage(spark, folder, "merged")).select("listing_id", "sector", "city")
    return geo.add_coords(located, gazetteer(spark))


SECTOR_CITY = "CASE WHEN contains(sector, 'bangalore') OR bool_or(city = 'bangalore') THEN 'bangalore' ELSE 'gurgaon' END"


@query("sector_city", over("final", f"SELECT sector, {SECTOR_CITY} AS city FROM final GROUP BY sector"))
def sector_city(spark, folder):
    return geo.sector_cities(final(spark, folder))


# ---------------------------------------------------------------- features


@query(
    "named_areas",
    over("featured0", f"SELECT listing_id, {s6('super_built_up_area')} AS super_built_up_area, {s6('built_up_area')} AS built_up_area, {s6('carpet_area')} AS carpet_area FROM featured0"),
)
def named_areas(spark, folder):
    areas = prepare.with_areas(stage(spark, folder, "located"))
    return areas.select("listing_id", *[r6(F.col(c)).alias(c) for c in ("super_built_up_area", "built_up_area", "carpet_area")])


@query("room_flags", over("featured0", 'SELECT listing_id, "study room", "servant room", "store room", "pooja room", others FROM featured0'))
def room_flags(spark, folder):
    return prepare.with_room_flags(stage(spark, folder, "located")).select("listing_id", *ft.ROOM_FLAGS)


@query("age_bucket", over("raw", f"SELECT listing_id, {sql.AGE} AS age FROM raw"))
def age_bucket(spark, folder):
    return raw_listings(spark, folder).select("listing_id", ft.age_bucket(F.col("agePossession")).alias("age"))


@query("luxury_score", over("featured", "SELECT listing_id, luxury_score FROM featured"))
def luxury_score(spark, folder):
    score = ft.luxury_score(ft.list_literal(F.col("features")))
    return stage(spark, folder, "located").select("listing_id", score.alias("luxury_score"))


@query(
    "bands",
    over("featured", """SELECT listing_id, CASE WHEN luxury_score < 0 THEN 'High' WHEN luxury_score < 50 THEN 'Low' WHEN luxury_score < 150 THEN 'Medium' WHEN luxury_score <= 175 THEN 'High' ELSE 'Low' END AS luxury,
      CASE WHEN floorNum >= 3 AND floorNum <= 10 THEN 'Mid Floor' WHEN floorNum >= 11 AND floorNum <= 51 THEN 'High Floor' ELSE 'Low Floor' END AS floor FROM featured"""),
)
def bands(spark, folder):
    return stage(spark, folder, "featured").select(
        "listing_id", ft.luxury_band(F.col("luxury_score")).alias("luxury"), ft.floor_band(F.col("floorNum")).alias("floor")
    )


@query(
    "furnish_counts",
    over(
        "raw",
        r"""SELECT listing_id, item, CASE WHEN contains(t, concat('No ', item)) THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(t, concat('(\d+) ', item), 1) AS INTEGER), 1) END AS n
        FROM texts, items WHERE contains(t, item) AND NOT contains(t, concat('No ', item))""",
        [
            ("texts", "SELECT listing_id, furnishDetails AS t FROM raw"),
            ("items", r"SELECT DISTINCT item FROM (SELECT trim(regexp_replace(unnest(string_split(replace(replace(replace(t, '[', ''), ']', ''), '''', ''), ', ')), 'No |\d+', '', 'g')) AS item FROM texts) WHERE item <> ''"),
        ],
    ),
)
def furnish_counts(spark, folder):
    return furnish.furnish_counts(raw_listings(spark, folder))


@query(
    "furnish_scaled",
    over(
        "located",
        f"""SELECT listing_id, item, {s6('n / std')} AS value FROM counted JOIN (
          SELECT item, sqrt(greatest(sum(n * n * weight) / w - (sum(n * weight) / w) ** 2, 0)) AS std FROM counted, (SELECT sum(weight) AS w FROM texts) GROUP BY item, w) USING (item)
        WHERE std > 1e-9""",
        [
            ("texts", """SELECT coalesce("furnishDetails", '') AS t, min(listing_id) AS listing_id, CAST(count(*) AS DOUBLE) AS weight FROM located GROUP BY ALL"""),
            ("items", r"SELECT DISTINCT item FROM (SELECT trim(regexp_replace(unnest(string_split(replace(replace(replace(t, '[', ''), ']', ''), '''', ''), ', ')), 'No |\d+', '', 'g')) AS item FROM texts) WHERE item <> ''"),
            ("counted", r"""SELECT * FROM (SELECT listing_id, weight, item, coalesce(TRY_CAST(regexp_extract(t, concat('(\d+) ', item), 1) AS INTEGER), 1) AS n
              FROM texts, items WHERE contains(t, item) AND NOT contains(t, concat('No ', item))) WHERE n > 0"""),
        ],
    ),
)
def furnish_scaled(spark, folder):
    """What the clusters are made of: item counts of the distinct texts in units of their deviation, shown at the first listing of a text."""
    located = stage(spark, folder, "located")
    shown = located.groupBy(F.coalesce("furnishDetails", F.lit("")).alias("text")).agg(F.min("listing_id").alias("listing_id"))
    return furnish.scaled_counts(furnish.distinct_texts(located)).join(shown, "text").select("listing_id", "item", r6(F.col("value")).alias("value"))


@query("furnish_clusters")
def furnish_clusters(spark, folder):
    return furnish.furnishing_levels(stage(spark, folder, "located")).select("listing_id", "furnishing_type")


# ---------------------------------------------------------------- outliers and gaps


@query("quartiles", over("quartiles", "SELECT q1, q3, q3 + 1.5 * (q3 - q1) AS upper FROM quartiles"))
def quartiles(spark, folder):
    featured = stage(spark, folder, "featured").drop(*prepare.TEXT_DROPS)
    return outliers.iqr_limit(rows.distinct_rows(featured))


TREATED = "listing_id, sector, price, price_per_sqft, area, bedRoom"


@query("iqr_fix", over("treated", f"SELECT {TREATED}, {s6('area_room_ratio')} AS area_room_ratio FROM treated"))
def iqr_fix(spark, folder):
    featured = stage(spark, folder, "featured").drop(*prepare.TEXT_DROPS)
    return outliers.treat_outliers(featured).select(*TREATED.split(", "), r6(F.col("area_room_ratio")).alias("area_room_ratio"))


@query(
    "apply_corrections",
    over(
        "featured",
        f"""SELECT listing_id, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE area END AS area,
        {s6("CASE WHEN p_size % 2 = 1 THEN p_retailprice ELSE carpet_area END")} AS carpet_area FROM featured LEFT JOIN part ON p_partkey = listing_id""",
    ),
)
def apply_corrections(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet")
    column = F.when(F.col("p_size") % 2 == 0, F.lit("area")).otherwise(F.lit("carpet_area"))
    corrections = part.select(F.col("p_partkey").alias("listing_id"), column.alias("column"), F.col("p_retailprice").alias("value"))
    fixed = outliers.apply_corrections(stage(spark, folder, "featured"), corrections, ["area", "carpet_area"])
    return fixed.select("listing_id", "area", r6(F.col("carpet_area")).alias("carpet_area"))


@query("reject_rows", over("featured", "SELECT listing_id, price, area FROM featured WHERE listing_id NOT IN (SELECT s_suppkey FROM supplier)"))
def reject_rows(spark, folder):
    bad = spark.read.parquet(f"{folder}/supplier.parquet").select(F.col("s_suppkey").alias("listing_id"))
    return rows.reject_rows(stage(spark, folder, "featured"), bad).select("listing_id", "price", "area")


@query("ratio_impute", over("inferred", f"SELECT listing_id, {s6('r_super')} AS r_super, {s6('r_carpet')} AS r_carpet, {s6('CASE WHEN inferred.built_up_area < 2000 AND price > 2.5 THEN coalesce(area, inferred.built_up_area) ELSE inferred.built_up_area END')} AS built_up_area FROM inferred, ratios"))
def ratio_impute(spark, folder):
    treated = stage(spark, folder, "treated")
    ratios = materialise(impute.area_ratios(treated), "ratios")
    return impute.impute_built_up(treated).select(
        "listing_id",
        r6(ratios.select("r_super").scalar()).alias("r_super"),
        r6(ratios.select("r_carpet").scalar()).alias("r_carpet"),
        r6(F.col("built_up_area")).alias("built_up_area"),
    )


def _modes_over(base: str, select: str) -> str:
    """Three mode passes over a table t(listing_id, sector, property_type, age)."""
    chain, table = [("pass0", base)], "pass0"
    for i, keys in enumerate((["sector", "property_type"], ["sector"], ["property_type"]), 1):
        k = ", ".join(keys)
        chain.append((f"top{i}", f"SELECT {k}, age AS m FROM {table} GROUP BY {k}, age QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, age) = 1"))
        chain.append((f"pass{i}", f"SELECT {table}.* REPLACE (CASE WHEN age = 'Undefined' THEN m ELSE age END AS age) FROM {table} JOIN top{i} USING ({k})"))
        table = f"pass{i}"
    return over("treated", select, chain)


@query("mode_impute", _modes_over("SELECT listing_id, sector, property_type, agePossession AS age FROM treated", "SELECT listing_id, age FROM pass3"))
def mode_impute(spark, folder):
    filled = impute.mode_fill(stage(spark, folder, "treated").select("listing_id", "sector", "property_type", "agePossession"))
    return filled.select("listing_id", F.col("agePossession").alias("age"))


IMPUTED = 'listing_id, city, property_type, sector, society, price, price_per_sqft, bedRoom, bathroom, balcony, floorNum, agePossession, luxury_score, others'


@query("impute", over("imputed", f"SELECT {IMPUTED}, {s6('built_up_area')} AS built_up_area FROM imputed"))
def impute_missing(spark, folder):
    return impute.impute(stage(spark, folder, "treated")).select(*IMPUTED.split(", "), r6(F.col("built_up_area")).alias("built_up_area"))


FINAL = 'listing_id, city, property_type, sector, price, bedRoom, bathroom, balcony, agePossession, "servant room", "store room", luxury_category, floor_category'


@query("final_table", over("final", f"SELECT {FINAL}, {s6('built_up_area')} AS built_up_area FROM final"))
def final_table(spark, folder):
    """The whole preparation; the cluster column is left to ``final_table_clustered``."""
    table = prepare.prepare(raw_listings(spark, folder)).drop("furnishing_type")
    return table.withColumn("built_up_area", r6(F.col("built_up_area")))


@query("final_table_clustered")
def final_table_clustered(spark, folder):
    return final(spark, folder)


FUNNEL = ["raw", "merged", "located", "treated", "final"]


@query("stage_funnel", over("final", " UNION ALL ".join(f"SELECT {i} AS ord, '{name}' AS stage, count(*) AS n_rows FROM {name}" for i, name in enumerate(FUNNEL))))
def stage_funnel(spark, folder):
    raw = raw_listings(spark, folder)
    return prepare.stage_funnel({"raw": raw, **{name: stage(spark, folder, name) for name in FUNNEL[1:]}})


# ---------------------------------------------------------------- market views


@query(
    "city_comparison",
    over(
        "final",
        """SELECT city, count(*) AS n_properties, count(*) FILTER (WHERE property_type = 'flat') AS flats, count(*) FILTER (WHERE property_type = 'house') AS houses,
        round_even(min(price) * 100, 0) / 100 AS price_min_cr, round_even(max(price) * 100, 0) / 100 AS price_max_cr, count(DISTINCT sector) AS unique_locations,
        round_even(median(price) * 100, 0) / 100 AS price_median_cr, CAST(trunc(median(built_up_area)) AS BIGINT) AS area_median_sqft FROM final GROUP BY city""",
    ),
)
def city_comparison(spark, folder):
    return market.city_comparison(final(spark, folder))


@query(
    "city_wide",
    over(
        "final",
        """SELECT city, count(*) AS total, count(*) FILTER (WHERE property_type = 'flat') AS flats, count(*) FILTER (WHERE property_type = 'house') AS houses,
        round_even(avg(price) * 100, 0) / 100 AS mean_price, count(DISTINCT sector) AS locations, round_even(median(price) * 100, 0) / 100 AS median_price,
        CAST(trunc(median(built_up_area)) AS BIGINT) AS median_sqft, CAST(trunc(median(price) * 1e7 / median(built_up_area)) AS BIGINT) AS median_rate FROM final GROUP BY city""",
    ),
)
def city_wide(spark, folder):
    return market.city_wide(final(spark, folder))


PROFILE = (
    "profile",
    f"""SELECT *, round_even(price * 1e7 / area, 0) AS price_per_sqft FROM (
      SELECT sector, {SECTOR_CITY} AS city, count(price) AS n, median(price) AS price, median(built_up_area) AS area FROM final GROUP BY sector)""",
)


@query("sector_profile", over("final", f"SELECT sector, city, n, {s6('price')} AS price, {s6('area')} AS area, price_per_sqft FROM profile", [PROFILE]))
def sector_profile(spark, folder):
    return market.sector_profile(final(spark, folder)).withColumns({"price": r6(F.col("price")), "area": r6(F.col("area"))})


MAP_SQL = f"""SELECT sector, city, n, {s6('price')} AS price, {s6('area')} AS area, price_per_sqft, lat, lon,
  CAST(trunc(share * 250 + 50) AS INTEGER) AS size, CAST(trunc(share * 255) AS INTEGER) AS red, CAST(trunc((1 - share) * 255) AS INTEGER) AS blue FROM (
  SELECT *, ({{m}} - min({{m}}) OVER ()) / (max({{m}}) OVER () - min({{m}}) OVER () + 1e-9) AS share FROM (
    SELECT profile.*, lat, lon FROM profile JOIN coords USING (sector, city)))"""


def _map_sql(metric: str) -> str:
    chain = over("final", "", [PROFILE, ("sectored2", "SELECT DISTINCT sector, city FROM profile")]).rstrip()
    return chain + "," + GEO_SQL.replace("FROM sectored", "FROM sectored2") + MAP_SQL.replace("{m}", metric)


@query("sector_map", _map_sql("price"))
def sector_map(spark, folder):
    points = market.sector_map(final(spark, folder), gazetteer(spark))
    return points.withColumns({"price": r6(F.col("price")), "area": r6(F.col("area"))})


@query("sector_map_first", f"SELECT sector, n FROM ({_map_sql('price')}) ORDER BY sector LIMIT 7")
def sector_map_first(spark, folder):
    """A caller's limit takes the first sectors by name."""
    return market.sector_map(final(spark, folder), gazetteer(spark), max_points=7).select("sector", "n")


@query("sector_map_counts", _map_sql("n"))
def sector_map_counts(spark, folder):
    points = market.sector_map(final(spark, folder), gazetteer(spark), "n")
    return points.withColumns({"price": r6(F.col("price")), "area": r6(F.col("area"))})


@query(
    "map_centre",
    over("final", "", [PROFILE, ("sectored2", "SELECT DISTINCT sector, city FROM profile")]).rstrip() + "," + GEO_SQL.replace("FROM sectored", "FROM sectored2")
    + f"SELECT {s6('median(lat)')} AS lat, {s6('median(lon)')} AS lon FROM profile JOIN coords USING (sector, city)",
)
def map_centre(spark, folder):
    points = geo.add_coords(market.sector_profile(final(spark, folder)), gazetteer(spark))
    return market.map_centre(points).select(r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"))


STATS = (
    "stats",
    """SELECT *, CAST(round_even(median_price * 1e7 / median_area, 0) AS BIGINT) AS price_per_sqft FROM (
      SELECT sector, count(price) AS listings, min(price) AS min_price, max(price) AS max_price, median(price) AS median_price, median(built_up_area) AS median_area
      FROM final GROUP BY sector) WHERE listings >= 3""",
)
STAT_COLUMNS = f"sector, listings, min_price, max_price, {s6('median_price')} AS median_price, {s6('median_area')} AS median_area, price_per_sqft"


def _stats6(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in ("median_price", "median_area")})


@query("sector_stats", over("final", f"SELECT {STAT_COLUMNS} FROM stats", [STATS]))
def sector_stats(spark, folder):
    return _stats6(market.sector_stats(final(spark, folder)))


for _metric in market.SECTOR_METRICS:
    @query(f"sector_rank_{_metric}", over("final", f"SELECT {STAT_COLUMNS} FROM (SELECT * FROM stats ORDER BY {_metric} DESC, sector LIMIT 12)", [STATS]))
    def sector_rank(spark, folder, metric=_metric):
        return _stats6(market.rank_sectors(market.sector_stats(final(spark, folder)), metric))


@query(
    "cheapest_priciest",
    over(
        "final",
        """SELECT side, CAST(place AS INTEGER) AS place, sector, listings, round_even(median_price * 100, 0) / 100 AS median_price FROM (
        SELECT 'cheapest' AS side, row_number() OVER (ORDER BY median_price, sector) AS place, * FROM stats
        UNION ALL SELECT 'priciest', row_number() OVER (ORDER BY median_price DESC, sector), * FROM stats) WHERE place <= 5""",
        [STATS],
    ),
)
def cheapest_priciest(spark, folder):
    return market.cheapest_priciest(market.sector_stats(final(spark, folder)))


@query(
    "market_compare",
    over(
        "final",
        f"""SELECT listings, market_low, market_high, market_median, {s6('1.5 - market_median')} AS difference, {s6('(1.5 - market_median) / market_median * 100')} AS percent,
        CASE WHEN abs((1.5 - market_median) / market_median * 100) < 5 THEN 'at the median' WHEN market_median < 1.5 THEN 'above' WHEN market_median >= 1.5 THEN 'below' END AS verdict
        FROM (SELECT count(*) AS listings, min(price) AS market_low, max(price) AS market_high, median(price) AS market_median FROM final WHERE city = 'gurgaon' AND property_type = 'flat' AND bedRoom = 3)""",
    ),
)
def market_compare(spark, folder):
    row = market.market_compare(final(spark, folder), 1.5, "gurgaon", "flat", 3)
    return row.withColumns({"difference": r6(F.col("difference")), "percent": r6(F.col("percent"))})


@query("kpi", over("final", "SELECT count(*) AS properties, count(DISTINCT sector) AS locations, median(price) AS median_price FROM final"))
def kpi(spark, folder):
    return market.kpi(final(spark, folder))


def _histogram_sql(column: str) -> str:
    return over(
        "final",
        f"""SELECT CAST(b AS INTEGER) AS bin, {s6('CASE WHEN b = 0 THEN low - (high - low) * 0.001 ELSE low + b * (high - low) / 20 END')} AS "left", {s6('low + (b + 1) * (high - low) / 20')} AS "right",
        (SELECT count(*) FROM final, ends e WHERE ({column} > low + b * (high - low) / 20 OR b = 0) AND ({column} <= low + (b + 1) * (high - low) / 20 OR b = 19)) AS count
        FROM range(20) AS r(b), ends""",
        [("ends", f"SELECT min({column}) AS low, max({column}) AS high FROM final")],
    )


for _column in ("price", "built_up_area"):
    @query(f"histogram_{_column}", _histogram_sql(_column))
    def histogram(spark, folder, column=_column):
        bins = market.histogram(final(spark, folder), column)
        return bins.withColumns({"left": r6(F.col("left")), "right": r6(F.col("right"))})


def _pivot_sql(row: str, levels: list[str] | None = None) -> str:
    wide = ", ".join(f"coalesce(round_even(median(price) FILTER (WHERE city = '{c}') * 100, 0) / 100, 0) AS {c}" for c in CITIES)
    plain = f"SELECT {row}, {wide} FROM final GROUP BY {row}"
    if levels is None:
        return over("final", plain)
    frame = ", ".join(f"({q(v)})" for v in levels)
    return over("final", f"SELECT {row}, {', '.join(CITIES)} FROM (VALUES {frame}) AS f({row}) LEFT JOIN ({plain}) USING ({row})")


for _row, _levels in (("bedRoom", None), ("property_type", None), ("luxury_category", market.LUXURY_ORDER)):
    @query(f"pivot_price_{_row}", _pivot_sql(_row, _levels))
    def pivot_price(spark, folder, row=_row, levels=_levels):
        return market.median_price_pivot(final(spark, folder), row, CITIES, levels)


@query("pivot_age", over("final", "SELECT agePossession, " + ", ".join(f"count(*) FILTER (WHERE city = '{c}') AS {c}" for c in CITIES) + " FROM final GROUP BY agePossession"))
def pivot_age(spark, folder):
    return market.count_pivot(final(spark, folder), "agePossession", CITIES)


for _column in ("bedRoom", "property_type", "sector"):
    @query(f"value_counts_{_column}", over("final", f"SELECT {_column}, count(*) AS count FROM final GROUP BY {_column}"))
    def value_counts(spark, folder, column=_column):
        return market.value_counts(final(spark, folder), column)


@query("luxury_counts", over("final", "SELECT luxury_category, count(final.listing_id) AS count FROM (VALUES ('Low'), ('Medium'), ('High')) AS l(luxury_category) LEFT JOIN final USING (luxury_category) GROUP BY luxury_category"))
def luxury_counts(spark, folder):
    return market.luxury_counts(final(spark, folder))


@query("furnishing_counts")
def furnishing_counts(spark, folder):
    return market.furnishing_counts(final(spark, folder))


@query("distinct_sectors", over("final", "SELECT DISTINCT sector FROM final WHERE city = 'gurgaon'"))
def distinct_sectors(spark, folder):
    return market.distinct_values(final(spark, folder), "sector", "gurgaon")


@query("select_listings", over("final", "SELECT listing_id, sector, price FROM final WHERE city = 'bangalore' AND property_type = 'flat' AND bedRoom = 3 AND price <= 3.0"))
def select_listings(spark, folder):
    chosen = rows.select_listings(final(spark, folder), city="bangalore", property_type="flat", bedrooms=3, budget_max=3.0)
    return chosen.select("listing_id", "sector", "price")


@query(
    "score_stats",
    over("final", " UNION ALL ".join(f"SELECT {q(c)} AS \"column\", {s6(f'avg({chr(34)}{c}{chr(34)})')} AS mean, {s6(f'stddev_pop({chr(34)}{c}{chr(34)})')} AS std FROM final" for c in similar.NUMERIC)),
)
def score_stats(spark, folder):
    stats = market.score_stats(final(spark, folder), similar.NUMERIC)
    return stats.withColumns({"mean": r6(F.col("mean")), "std": r6(F.col("std"))})


def _drawn(seed: int, key: str = "listing_id") -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 15) AS BIGINT)"


@query("sample_points", over("final", f"SELECT listing_id, built_up_area, price, property_type FROM final ORDER BY {_drawn(42)}, listing_id LIMIT 100"))
def sample_points(spark, folder):
    points = final(spark, folder).select("listing_id", "built_up_area", "price", "property_type")
    return rows.seeded_sample(points, 100)


@query("shuffled_order", f"SELECT o_orderkey, row_number() OVER (ORDER BY {_drawn(7, 'o_orderkey')}, o_orderkey) AS place FROM orders")
def shuffled_order(spark, folder):
    """All orders in a random order that any engine repeats."""
    return rows.random_places(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey"), "o_orderkey", seed=7)


@query("folds", over("merged", f"SELECT listing_id, CAST({_drawn(42)} % 10 AS INTEGER) AS fold, {_drawn(43)} % 1000 < 200 AS held_out FROM merged"))
def folds(spark, folder):
    return stage(spark, folder, "merged").select("listing_id", rows.fold_of().alias("fold"), rows.is_held_out().alias("held_out"))


@query(
    "price_display",
    over("final", f"SELECT listing_id, {s6('round(price * 0.9, 2)')} AS low, {s6('round(price * 1.1, 2)')} AS high, CAST(trunc(price * 1e7 / built_up_area) AS BIGINT) AS rate, {s6('ln(1 + price)')} AS log_price FROM final"),
)
def price_display(spark, folder):
    band = lb.price_band(F.col("price"))
    return final(spark, folder).select(
        "listing_id",
        r6(band["low"]).alias("low"),
        r6(band["high"]).alias("high"),
        lb.implied_rate(F.col("price"), F.col("built_up_area")).alias("rate"),
        r6(lb.log_price(F.col("price"))).alias("log_price"),
    )


# ---------------------------------------------------------------- similarity

RULED = (
    "ruled",
    r"""SELECT final.*, CAST(CASE WHEN n <= 2 THEN 0 WHEN n <= 5 THEN 1 ELSE 2 END AS INTEGER) AS furnishing_type FROM final JOIN (
      SELECT listing_id, coalesce(len(list_filter(list_transform(string_split(regexp_replace("furnishDetails", '[\[\]'']', '', 'g'), ', '), lambda x: trim(x)),
        lambda x: x <> '' AND NOT starts_with(x, 'No '))), 0) AS n FROM merged) USING (listing_id)""",
)
SCORED = [
    RULED,
    ("stat", "SELECT " + ", ".join(f'avg("{c}") AS "m {c}", stddev_pop("{c}") AS "s {c}"' for c in similar.NUMERIC) + " FROM ruled"),
    ("z", "SELECT ruled.*, " + ", ".join(f'CASE WHEN "s {c}" > 0 THEN ("{c}" - "m {c}") / "s {c}" ELSE 0 END AS z{i}' for i, c in enumerate(similar.NUMERIC)) + " FROM ruled, stat"),
    ("scored", "SELECT *, sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(6)) + ") AS norm FROM z"),
]


def _score(weights: tuple[float, float, float]) -> str:
    num = "CASE WHEN a.norm * b.norm > 0 THEN (" + " + ".join(f"a.z{i} * b.z{i}" for i in range(6)) + ") / (a.norm * b.norm) ELSE 0 END"
    cat = "(" + " + ".join(f"CAST(a.{c} = b.{c} AS INTEGER)" for c in similar.CATEGORICAL) + f") / {len(similar.CATEGORICAL)}.0"
    loc = "(CAST(a.sector = b.sector AS INTEGER) + CAST(a.city = b.city AS INTEGER)) / 2.0"
    return f"{weights[0]} * ({num}) + {weights[1]} * {cat} + {weights[2]} * {loc}"


def _recommend_sql(where: str, same_city: bool, weights=similar.WEIGHTS, top_n: int = 5) -> str:
    """Neighbours of the median-priced listing among those meeting a condition."""
    anchor = ("anchor", f"SELECT listing_id AS aid FROM final, (SELECT median(price) AS m FROM final WHERE {where}) WHERE {where} ORDER BY abs(price - m), listing_id LIMIT 1")
    city = "AND a.city = b.city" if same_city else ""
    ranked = (
        "ranked",
        f"""SELECT b.*, {_score(weights)} AS score FROM scored a JOIN anchor ON a.listing_id = aid JOIN scored b ON b.listing_id <> aid {city}""",
    )
    return over(
        "final",
        f"""SELECT CAST(row_number() OVER (ORDER BY score DESC, listing_id) AS INTEGER) AS "Rank", listing_id, sector, price, round(score, 4) AS "SimilarityScore"
        FROM ranked ORDER BY score DESC, listing_id LIMIT {top_n}""",
        [*SCORED, anchor, ranked],
    )


RESULT = ["Rank", "listing_id", "sector", "price", "SimilarityScore"]


@query("recommend_filters", _recommend_sql("city = 'bangalore' AND property_type = 'flat' AND bedRoom = 3 AND price <= 3.0", True))
def recommend_filters(spark, folder):
    table = ruled(spark, folder)
    return similar.recommend_by_filters(table, city="bangalore", property_type="flat", bedrooms=3, budget_max=3.0).select(*RESULT)


@query("recommend", _recommend_sql("true", False, top_n=10))
def recommend(spark, folder):
    table = ruled(spark, folder)
    return similar.recommend(table, similar.median_anchor(table), top_n=10).select(*RESULT)


@query("recommend_weights", _recommend_sql("city = 'gurgaon' AND property_type = 'house'", True, (1.0, 0.0, 0.0)))
def recommend_weights(spark, folder):
    table = ruled(spark, folder)
    return similar.recommend_by_filters(table, city="gurgaon", property_type="house", weights=(1.0, 0.0, 0.0)).select(*RESULT)


@query(
    "recommend_summary",
    _recommend_sql("city = 'gurgaon'", True).replace('SELECT CAST(row_number()', 'SELECT count(*) AS matches, max("SimilarityScore") AS top_score, round_even(avg("SimilarityScore") * 1e6, 0) / 1e6 AS avg_score FROM (SELECT CAST(row_number()') + ")",
)
def recommend_summary(spark, folder):
    results = similar.recommend_by_filters(ruled(spark, folder), city="gurgaon")
    return market.result_summary(results).withColumn("avg_score", r6(F.col("avg_score")))


ANCHORS = (
    "anchors",
    """SELECT DISTINCT arg_min(listing_id, (abs(price - mid), listing_id)) AS anchor_id
      FROM final JOIN (SELECT sector, city, median(price) AS mid FROM final GROUP BY ALL) USING (sector, city) GROUP BY sector, city""",
)


@query(
    "similar_pairs",
    over(
        "final",
        f"""SELECT anchor_id, CAST(r AS INTEGER) AS "Rank", listing_id, round(score, 4) AS "SimilarityScore" FROM (
        SELECT anchor_id, b.listing_id, {_score(similar.WEIGHTS)} AS score, row_number() OVER (PARTITION BY anchor_id ORDER BY {_score(similar.WEIGHTS)} DESC, b.listing_id) AS r
        FROM anchors JOIN scored a ON a.listing_id = anchor_id JOIN scored b ON b.listing_id <> anchor_id) WHERE r <= 5""",
        [*SCORED, ANCHORS],
    ),
)
def similar_pairs(spark, folder):
    table = ruled(spark, folder)
    return similar.similar_to_each(table, similar.group_anchors(table, ["sector", "city"]))


# ---------------------------------------------------------------- drivers and price models


@query(
    "driver_features",
    over(
        "final",
        f"""SELECT listing_id, CASE property_type WHEN 'flat' THEN 0 WHEN 'house' THEN 1 END AS property_type,
        CASE luxury_category WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END AS luxury_category,
        CASE agePossession WHEN 'Relatively New' THEN 'new' WHEN 'New Property' THEN 'new' WHEN 'Moderately Old' THEN 'old' WHEN 'Old Property' THEN 'old'
          WHEN 'Under Construction' THEN 'under construction' ELSE agePossession END AS "agePossession", {s6('ln(1 + price)')} AS label FROM final""",
    ),
)
def driver_features(spark, folder):
    rows_ = drivers.driver_features(final(spark, folder))
    return rows_.select("listing_id", "property_type", "luxury_category", "agePossession", r6(F.col("label")).alias("label"))


@query("driver_coefs")
def driver_coefs(spark, folder):
    return drivers.coefficients(drivers.fit_drivers(final(spark, folder), "gurgaon"))


@query("driver_importance")
def driver_importance(spark, folder):
    ranked = drivers.importance(drivers.fit_drivers(final(spark, folder), "bangalore"))
    return rows.without_prefixes(ranked, "feature", ["sector_", "agePossession_"]).withColumn("readable", lb.readable_feature(F.col("feature")))


@query("driver_top")
def driver_top(spark, folder):
    return drivers.top_drivers(drivers.fit_drivers(final(spark, folder)))


@query("driver_summary")
def driver_summary(spark, folder):
    return drivers.fit_summary(drivers.fit_drivers(final(spark, folder), "gurgaon", alpha=0.0))


@query(
    "driver_single",
    over(
        "final",
        f"""SELECT {s6('regr_r2(y, x)')} AS r2, {s6('1 - (1 - regr_r2(y, x)) * (count(*) - 1) / (count(*) - 2)')} AS adj_r2, count(*) AS n_obs, 1 AS df_model,
        {s6('regr_slope(y, x) * stddev_pop(x)')} AS coef, round_even((exp(100 * regr_slope(y, x)) - 1) * 100 * 1e4, 0) / 1e4 AS price_pct
        FROM (SELECT ln(1 + price) AS y, built_up_area AS x FROM final WHERE city = 'gurgaon')""",
    ),
)
def driver_single(spark, folder):
    """Least squares on one driver: its fit, standardised coefficient and the impact of 100 units."""
    fitted = drivers.fit_drivers(final(spark, folder), "gurgaon", 0.0, ["built_up_area"], [])
    coef = drivers.coefficients(fitted).select(r6(F.col("coef")).alias("coef"))
    percent = drivers.impact(fitted, "built_up_area", 100.0).select("price_pct").scalar()
    row = drivers.fit_summary(fitted).select(r6(F.col("r2")).alias("r2"), r6(F.col("adj_r2")).alias("adj_r2"), "n_obs", "df_model")
    return row.withColumn("coef", coef.scalar()).withColumn("price_pct", percent)


PAIR = ["built_up_area", "bathroom"]
MOMENTS = (
    "moments",
    """SELECT n, syy, s11, s22, s12, s1y, s2y, s11 * s22 - s12 * s12 AS det FROM (SELECT count(*) AS n, regr_syy(y, a) AS syy, regr_sxx(y, a) AS s11,
      regr_sxx(y, b) AS s22, regr_sxy(a, b) AS s12, regr_sxy(y, a) AS s1y, regr_sxy(y, b) AS s2y
      FROM (SELECT ln(1 + price) AS y, built_up_area AS a, CAST(bathroom AS DOUBLE) AS b FROM final WHERE city = 'gurgaon'))""",
)
SLOPES = (
    "slopes",
    """SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS noise, sqrt(s11 / n) AS d1, sqrt(s22 / n) AS d2 FROM (
      SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2 FROM moments)""",
)


@query(
    "driver_pair_table",
    over(
        "final",
        f"""SELECT feature, {s6('coef')} AS coef, {s6('std_error')} AS std_error, {s6('coef / std_error')} AS t, {s6("1 - t_within")} AS p FROM (
        SELECT *, CASE WHEN v % 2 = 0 THEN s * (1 + coalesce(even, 0)) ELSE 2 / pi() * (atan(x) + s * sqrt(c2) * (1 + coalesce(odd, 0))) END AS t_within FROM (
          SELECT *, (SELECT sum(exp(l) * c2 ** j) FROM factors WHERE j < v / 2 AND kind = 0) AS even,
            (SELECT sum(exp(l) * c2 ** j) FROM factors WHERE j <= (v - 3) / 2 AND kind = 1) AS odd FROM (
              SELECT *, x / sqrt(1 + x * x) AS s, 1 / (1 + x * x) AS c2 FROM (
                SELECT *, n - 3 AS v, abs(coef / std_error) / sqrt(n - 3) AS x FROM sides))))""",
        [
            MOMENTS,
            SLOPES,
            ("sides", """SELECT 'built_up_area' AS feature, b1 * d1 AS coef, sqrt(noise * s22 / det) * d1 AS std_error, n FROM slopes
              UNION ALL SELECT 'bathroom', b2 * d2, sqrt(noise * s11 / det) * d2, n FROM slopes"""),
            ("factors", """SELECT 0 AS kind, j, sum(ln((2 * j - 1) / (2.0 * j))) OVER (ORDER BY j) AS l FROM range(1, 20000) AS r(j)
              UNION ALL SELECT 1, j, sum(ln((2.0 * j) / (2 * j + 1))) OVER (ORDER BY j) FROM range(1, 20000) AS r(j)"""),
        ],
    ),
)
def driver_pair_table(spark, folder):
    """Least squares on two features: coefficients, errors, t and its p from the t distribution."""
    found = drivers.coefficient_table(drivers.fit_drivers(final(spark, folder), "gurgaon", 0.0, PAIR, []))
    return found.withColumns({c: r6(F.col(c)) for c in ("coef", "std_error", "t", "p")})


@query(
    "driver_pair_ridge",
    over(
        "final",
        f"""SELECT feature, {s6('c')} AS coefficient, {s6('abs(c)')} AS abs_coef, CASE WHEN c > 0 THEN '+' ELSE '-' END AS direction,
        CAST(row_number() OVER (ORDER BY abs(c) DESC, feature) AS INTEGER) AS place FROM (
          SELECT unnest(['built_up_area', 'bathroom']) AS feature, unnest([((n + 50) * z1 - n * r * z2) / d, ((n + 50) * z2 - n * r * z1) / d]) AS c FROM (
            SELECT *, (n + 50) * (n + 50) - n * r * n * r AS d FROM (
              SELECT n, s12 / sqrt(s11 * s22) AS r, s1y / sqrt(s11 / n) AS z1, s2y / sqrt(s22 / n) AS z2 FROM moments)))""",
        [MOMENTS],
    ),
)
def driver_pair_ridge(spark, folder):
    """Ridge with a penalty of 50 on two standardised features, in the order of the importance table."""
    found = drivers.importance(drivers.fit_drivers(final(spark, folder), "gurgaon", 50.0, PAIR, []))
    place = F.row_number().over(Window.orderBy(F.desc("abs_coef"), "feature"))
    return found.withColumn("place", place).withColumns({c: r6(F.col(c)) for c in ("coefficient", "abs_coef")})


CODED = ["city", *price.CATEGORIES]
CELLS = [
    RULED,
    ("cells", " UNION ALL ".join(f"SELECT listing_id, city AS of_city, '{c}' AS col, CAST({c} AS VARCHAR) AS level FROM ruled" for c in CODED)),
    ("known", "SELECT DISTINCT col, level FROM cells WHERE of_city = 'gurgaon' AND level IS NOT NULL"),
    ("coded", "SELECT col, level, row_number() OVER (PARTITION BY col ORDER BY level) - 1 AS position FROM known"),
]


@query("one_hot_rows", over("final", "SELECT listing_id, col || '_' || level AS feature, CAST(1 AS DOUBLE) AS value FROM cells JOIN coded USING (col, level) WHERE position > 0", CELLS))
def one_hot_rows(spark, folder):
    """Levels of one city, codes of the listings of both: unknown levels and base levels have no row."""
    table = ruled(spark, folder)
    levels = encode.level_table(table.where("city = 'gurgaon'"), CODED)
    return encode.one_hot(table, levels, CODED)


@query(
    "feature_names",
    over(
        "final",
        """SELECT col || '_' || level AS feature, CASE col WHEN 'sector' THEN '📍 ' || level WHEN 'agePossession' THEN '🕒 Age: ' || level ELSE col || '_' || level END AS readable,
        CAST(position AS INTEGER) AS position FROM coded WHERE position > 0 AND col NOT IN ('balcony', 'luxury_category')""",
        CELLS,
    ),
)
def feature_names(spark, folder):
    """Encoded features as people read them, without two columns."""
    levels = encode.level_table(ruled(spark, folder).where("city = 'gurgaon'"), CODED).where("position > 0")
    shown = rows.without_prefixes(levels, "feature", ["balcony_", "luxury_category_"])
    return shown.select("feature", lb.readable_feature(F.col("feature")).alias("readable"), "position")


@query(
    "stored_model",
    over(
        "final",
        """SELECT listing_id, guess AS predicted_price, CAST(format('{:.2f}', guess * 0.9) AS DOUBLE) AS low, CAST(format('{:.2f}', guess * 1.1) AS DOUBLE) AS high,
        CAST(trunc(guess * 1e7 / built_up_area) AS BIGINT) AS rate, 0 AS "servant room", 'unfurnished' AS furnishing_type, 'Low' AS luxury_category, 'Mid Floor' AS floor_category
        FROM (SELECT listing_id, built_up_area, round_even((exp(a + b * built_up_area) - 1) * 100, 0) / 100 AS guess
              FROM final, (SELECT regr_slope(ln(1 + price), built_up_area) AS b, regr_intercept(ln(1 + price), built_up_area) AS a FROM final))""",
    ),
)
def stored_model(spark, folder):
    """A least-squares model fitted once, stored, loaded and asked for the price of requests that leave columns out.

    A later write that was torn is not read.
    """
    table, path = final(spark, folder), new_path(spark, "model")
    area = VectorAssembler(inputCols=["built_up_area"], outputCol="features")
    fitted = Pipeline(stages=[area, LinearRegression(solver="normal")]).fit(price.training_frame(table))
    torn = store.save(spark, fitted, path)
    delete(spark, f"{torn}/{store.WHOLE}")
    delete(spark, f"{torn}/model/stages")
    store.save(spark, fitted, path)
    model = store.load_or_fit(spark, path, lambda: None)
    priced = price.predict(model, table.select("listing_id", "sector", "built_up_area"))
    asked = ["servant room", "furnishing_type", "luxury_category", "floor_category"]
    return priced.select("listing_id", "predicted_price", "likely.low", "likely.high", "rate", *asked)


@query(
    "driver_single_table",
    over(
        "final",
        f"""SELECT 'built_up_area' AS feature, {s6('slope * sd')} AS coef, {s6('sqrt(sse / (n - 2) / n)')} AS std_error,
        {s6('slope * sd / sqrt(sse / (n - 2) / n)')} AS t FROM (SELECT regr_slope(y, x) AS slope, stddev_pop(x) AS sd, count(*) AS n,
        regr_syy(y, x) * (1 - regr_r2(y, x)) AS sse FROM (SELECT ln(1 + price) AS y, built_up_area AS x FROM final WHERE city = 'gurgaon'))""",
    ),
)
def driver_single_table(spark, folder):
    """Standard error and t of the one coefficient."""
    fitted = drivers.fit_drivers(final(spark, folder), "gurgaon", 0.0, ["built_up_area"], [])
    found = drivers.coefficient_table(fitted).select("feature", "coef", "std_error", "t")
    return found.withColumns({c: r6(F.col(c)) for c in ("coef", "std_error", "t")})


@query(
    "driver_single_fit",
    over(
        "final",
        f"""SELECT {s6('(syy - sse) / (sse / (n - 2))')} AS fstat, {s6('n * (ln(2 * pi()) + ln(sse / n) + 1) + 4')} AS aic
        FROM (SELECT count(*) AS n, regr_syy(y, x) AS syy, regr_syy(y, x) * (1 - regr_r2(y, x)) AS sse
              FROM (SELECT ln(1 + price) AS y, built_up_area AS x FROM final WHERE city = 'gurgaon'))""",
    ),
)
def driver_single_fit(spark, folder):
    fitted = drivers.fit_drivers(final(spark, folder), "gurgaon", 0.0, ["built_up_area"], [])
    return drivers.fit_summary(fitted).select(r6(F.col("fstat")).alias("fstat"), r6(F.col("aic")).alias("aic"))


@query(
    "driver_single_ridge",
    over(
        "final",
        f"""SELECT 'built_up_area' AS feature, {s6('slope * sd * n / (n + 50)')} AS coefficient, {s6('abs(slope * sd * n / (n + 50))')} AS abs_coef,
        CASE WHEN slope > 0 THEN '+' ELSE '-' END AS direction FROM (SELECT regr_slope(y, x) AS slope, stddev_pop(x) AS sd, count(*) AS n
        FROM (SELECT ln(1 + price) AS y, built_up_area AS x FROM final WHERE city = 'gurgaon'))""",
    ),
)
def driver_single_ridge(spark, folder):
    """Ridge with a penalty of 50 on one standardised feature, as the importance table shows it."""
    fitted = drivers.fit_drivers(final(spark, folder), "gurgaon", 50.0, ["built_up_area"], [])
    found = drivers.importance(fitted)
    return found.withColumns({c: r6(F.col(c)) for c in ("coefficient", "abs_coef")})


@query("driver_cv")
def driver_cv(spark, folder):
    return drivers.driver_cv(final(spark, folder), "gurgaon")


@query("impact")
def impact(spark, folder):
    return drivers.impact(drivers.fit_drivers(final(spark, folder), "gurgaon"), "built_up_area", 100.0)


@query("price_predict")
def price_predict(spark, folder):
    """The published forest, fitted on all listings and applied to all of them."""
    table = final(spark, folder)
    model, _ = price.fit_final(table, price.forest())
    return price.predict(model, table).select("listing_id", "price", "predicted_price", "likely.low", "likely.high", "rate")


@query("price_compare")
def price_compare(spark, folder):
    """Both models at their published sizes, over ten folds."""
    models = {"forest": price.forest(), "boosted": price.boosted()}
    return price.compare(final(spark, folder), models)


# ---------------------------------------------------------------- pages


def _entities(expr: str) -> str:
    """Character references decoded as HTML does: these names need no closing semicolon."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        expr = f"regexp_replace({expr}, '&{name};?', {q(char)}, 'g')"
    return expr


def _tag_text(pattern: str) -> str:
    return f"trim({_entities(f'regexp_extract(html, {q(pattern)}, 1)')})"


@query(
    "page_fields",
    f"SELECT page_id, {_tag_text('(?s)<title>(.*?)</title>')} AS title, {_tag_text('(?s)<h1>(.*?)</h1>')} AS heading, "
    f"{_tag_text('(?s)<div class=.ad.>(.*?)</div>')} AS ad, {_tag_text('(?s)<a [^>]*>(.*?)</a>')} AS first_link FROM pages",
)
def page_fields(spark, folder):
    spec = {"title": {"tag": "title"}, "heading": {"tag": "h1"}, "ad": {"tag": "div", "cls": "ad"}, "first_link": {"tag": "a"}}
    return pages.page_fields(read_pages(spark, f"{folder}/pages.parquet"), spec)


@query(
    "page_links",
    r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS place, regexp_extract(item, 'href="([^"]*)"', 1) AS href, """
    + f"trim({_entities('regexp_extract(item, ' + q('(?s)>(.*?)</a>') + ', 1)')}) AS text FROM ("
    + r"""SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM (
      SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>.*?</a>') AS items FROM pages))""",
)
def page_links(spark, folder):
    return pages.page_links(read_pages(spark, f"{folder}/pages.parquet"))


BLOCKED = "regexp_matches(upper(html), 'ACCESS DENIED|CAPTCHA|ROBOT|CHROME-ERROR|NETERROR|ERR_NAME_NOT_RESOLVED|ERR_CONNECTION|ERR_TIMED_OUT')"


@query("blocked_pages", f"SELECT page_id, {BLOCKED} AS blocked FROM pages")
def blocked_pages(spark, folder):
    table = read_pages(spark, f"{folder}/pages.parquet")
    return table.select("page_id", pages.is_blocked(F.col("html")).alias("blocked"))


@query("page_rejects", f"SELECT page_id, url, {BLOCKED} AS blocked FROM pages WHERE NOT regexp_matches(html, '<div [^>]*data-label=.SEARCH')")
def page_rejects(spark, folder):
    return pages.page_rejects(read_pages(spark, f"{folder}/pages.parquet"))


SITE = "site.example"
ORDER_PAGES = f"WITH pages AS ({ORDER_PAGES_SQL.strip()}),\n" + """
base AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS ks, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS lac, o_orderkey % 3 <> 0 AS unit,
  CASE WHEN o_orderkey % 3 = 0 THEN 'http://site.example/d/new-park-' || o_orderkey ELSE '/d/' || o_orderkey END AS link FROM orders),
cards AS (SELECT *, CASE WHEN unit THEN ks ELSE '' END AS property_id,
  CASE WHEN unit THEN 'Green & Co ' || k % 40 WHEN k % 2 = 0 THEN '' ELSE 'Park ' || k % 7 END AS society FROM base),
named AS (SELECT *, CASE WHEN unit THEN (1 + k % 5) || ' BHK Flat in Sector ' || (1 + k % 100) WHEN society = '' THEN 'New Park ' || ks ELSE society END AS property_name
  FROM cards),
details AS (SELECT *, CASE WHEN k % 3 = 1 THEN '' ELSE 'R' || ks END AS page_property_id, (1 + k % 4) || ' Bathrooms' AS bathroom,
  '["Metro ' || k % 9 || '","Mall"]' AS "nearbyLocations", CASE WHEN k % 2 = 0 THEN '["' || k % 4 || ' Fan","No AC"]' ELSE '[]' END AS "furnishDetails",
  CASE WHEN k % 2 = 0 THEN '["Spa","Park"]' ELSE '["Gate"]' END AS features, '["' || (1 + k % 5) || ' / 5"]' AS rating FROM named WHERE k % 5 <> 0),
listings AS (SELECT *, CASE WHEN page_property_id = '' THEN property_id ELSE page_property_id END AS own_id, CASE WHEN unit THEN 'By 2027' ELSE '' END AS possession,
  CASE WHEN unit THEN CAST(3000 + k % 900 AS VARCHAR) ELSE '' END AS psqft FROM details
  WHERE unit OR k = (SELECT min(k) FROM base WHERE NOT unit))
"""


def _unit(value: str) -> str:
    return f"CASE WHEN unit THEN {value} ELSE '' END"


@query(
    "page_cards",
    ORDER_PAGES + f"""SELECT k * 4 AS page_id, property_id, property_name, link, society, {_unit("lac || ' Lac'")} AS card_price,
    {_unit('CAST(3000 + k % 900 AS VARCHAR)')} AS card_psqft, {_unit("(300 + k % 700) || ' sqft'")} AS card_area, {_unit("'By 2027'")} AS card_possess,
    {_unit("'card text'")} AS card_desc FROM named""",
)
def page_cards(spark, folder):
    return pages.cards(order_pages(spark, folder), SITE).drop("pos")


LISTS = ["nearbyLocations", "furnishDetails", "features", "rating"]


@query(
    "page_details",
    ORDER_PAGES + """SELECT link, bathroom, page_property_id, CASE WHEN k % 7 = 0 THEN '' ELSE '₹ ' || lac || ' Lac' END AS price,
    CASE WHEN k % 4 = 0 THEN '' ELSE 'Homes no ' || ks || ' to see' END AS description, "nearbyLocations", "furnishDetails", features, rating FROM details""",
)
def page_details(spark, folder):
    table = order_pages(spark, folder)
    found = pages.details(table.where(F.col("url").contains("/d/")))
    return found.withColumns({c: F.to_json(c) for c in LISTS}).select("link", "bathroom", "page_property_id", "price", "description", *LISTS)


@query(
    "listings_flats",
    ORDER_PAGES + """SELECT link, own_id AS property_id, property_name, society, bathroom, possession AS "agePossession", psqft AS area,
    "nearbyLocations", "furnishDetails", features, rating FROM listings""",
)
def listings_flats(spark, folder):
    """From search pages over cards and detail pages to raw listings."""
    found = pages.listings_from_pages(order_pages(spark, folder), "flats", SITE)
    return found.select("link", "property_id", "property_name", "society", "bathroom", "agePossession", "area", *LISTS)


@query("listings_houses", ORDER_PAGES + 'SELECT link, own_id AS property_id, psqft AS rate, \'\' AS "noOfFloor" FROM listings')
def listings_houses(spark, folder):
    return pages.listings_from_pages(order_pages(spark, folder), "houses", SITE).select("link", "property_id", "rate", "noOfFloor")


@query(
    "listings_land",
    ORDER_PAGES + """SELECT link, own_id AS property_id, possession, '' AS "noOfOpenSides", '' AS "floorNumAllowed", features FROM listings""",
)
def listings_land(spark, folder):
    return pages.listings_from_pages(order_pages(spark, folder), "land", SITE).select(
        "link", "property_id", "possession", "noOfOpenSides", "floorNumAllowed", "features"
    )


@query("listings_unseen", ORDER_PAGES + "SELECT link, own_id AS property_id FROM listings WHERE unit AND k % 2 = 1")
def listings_unseen(spark, folder):
    """Cards whose id is stored already are left out before their detail page is read."""
    table = order_pages(spark, folder)
    units = pages.cards(table, SITE).select("property_id").where("property_id = '' or cast(property_id as bigint) % 2 = 0")
    return pages.listings_from_pages(table, "flats", SITE, known=units).select("link", "property_id")


@query("order_pages_blocked", ORDER_PAGES + f"SELECT page_id, {BLOCKED} AS blocked FROM pages")
def order_pages_blocked(spark, folder):
    return order_pages(spark, folder).select("page_id", pages.is_blocked(F.col("html")).alias("blocked"))


@query("order_pages_rejects", ORDER_PAGES + f"SELECT page_id, url, {BLOCKED} AS blocked FROM pages WHERE NOT contains(html, 'data-label=\"SEARCH\"')")
def order_pages_rejects(spark, folder):
    return pages.page_rejects(order_pages(spark, folder))


# ---------------------------------------------------------------- sources and sinks


@query("sources_csv", over("raw", """SELECT property_id, city, property_type, rate, society, CASE WHEN property_type = 'house' THEN '' ELSE facing END AS facing,
    description FROM raw"""))
def sources_csv(spark, folder):
    """The listings written as four CSV sources, house files in another column order and without one column, and read back as one table."""
    raw = raw_listings(spark, folder)
    sources = []
    for city in CITIES:
        for kind in ("flat", "house"):
            part = raw.where((F.col("city") == city) & (F.col("property_type") == kind)).drop("listing_id", "city", "property_type")
            if kind == "house":
                part = part.withColumnRenamed("floorNum", "noOfFloor").drop("facing")
                part = part.select(*sorted(part.columns, reverse=True))
            else:
                part = part.withColumnRenamed("rate", "area")
            path = new_path(spark, f"{city}-{kind}")
            part.write.option("header", True).option("escape", '"').csv(path)
            sources.append((path, kind, city))
    sources.append((new_path(spark, "absent"), "flat", "gurgaon"))
    return read_sources(spark, sources).select("property_id", "city", "property_type", "rate", "society", "facing", "description")


@query("sink_by_city", over("raw", "SELECT city, property_type, property_id, min(listing_id) AS listing_id FROM raw GROUP BY ALL"))
def sink_by_city(spark, folder):
    """One city written, the other added beside it, then all rows appended twice: every key of a folder is there once."""
    raw = raw_listings(spark, folder).select("listing_id", "property_id", "city", "property_type")
    raw = rows.first_per_key(raw, ["city", "property_type", "property_id"])
    path = new_path(spark, "by-city")
    write_by_city_and_kind(raw.where("city = 'gurgaon' and listing_id % 2 = 0"), path)
    write_by_city_and_kind(raw.where("city = 'bangalore'"), path)
    for _ in range(2):
        append_by_city_and_kind(raw, path)
    return spark.read.parquet(path).select("city", "property_type", "property_id", "listing_id")


@query("stage_round_trip", over("final", f"SELECT {FINAL} FROM final"))
def stage_round_trip(spark, folder):
    """The final table as a written stage, read with its declared types."""
    path = new_path(spark, "stage")
    write_stage(final(spark, folder), path)
    names = [c.strip().strip('"') for c in FINAL.split(",")]
    return read_stage(spark, path, FINAL_SCHEMA).select(*names)


@query("merge_parts", over("merged", f"SELECT {sql.CLEAN_COLUMNS} FROM merged"))
def merge_parts(spark, folder):
    """Every city cleaned for itself, then merged."""
    raw = raw_listings(spark, folder)
    parts = [clean.clean(raw.where(F.col("city") == city)) for city in CITIES]
    return clean.merge_sources(parts).select(*sql.CLEAN_COLUMNS.split(", "))


@query("sector_sizes", over("final", "SELECT listing_id, sector, count(*) OVER (PARTITION BY sector) AS group_size FROM final"))
def sector_sizes(spark, folder):
    return rows.with_group_size(final(spark, folder).select("listing_id", "sector"), "sector")


# ---------------------------------------------------------------- ingest


@query(
    "unseen_keys",
    over("raw", "SELECT listing_id, property_id FROM raw WHERE city = 'bangalore' AND property_id NOT IN (SELECT property_id FROM raw WHERE city = 'gurgaon')"),
)
def unseen_keys(spark, folder):
    """Bangalore listings whose id a stored Gurgaon table does not hold."""
    raw = raw_listings(spark, folder).select("listing_id", "property_id", "city")
    sink = new_path(spark, "gurgaon")
    raw.where(F.col("city") == "gurgaon").write.parquet(sink)
    new = raw.where(F.col("city") == "bangalore")
    return unseen(new, stored_keys(spark, sink)).select("listing_id", "property_id")


@query(
    "ingest_new",
    over(
        "facts",
        """SELECT listing_id, property_id, city, price FROM facts
        WHERE NOT (trim(price) = '' AND trim(bedRoom) = '' AND trim(areaWithType) = '' AND trim(rate) = '' AND bed_min IS NULL AND price_min IS NULL AND area_min IS NULL)
        QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY listing_id) = 1""",
    ),
)
def ingest_new(spark, folder):
    """The listings as a file stream over the orders, taken into a new sink."""
    orders, customer, nation = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "customer", "nation"))
    arriving = ingest.landing_stream(spark, f"{folder}/orders.parque[t]", orders.schema)
    sink = new_path(spark, "sink")
    run = ingest.ingest(raw_listings_of(arriving, customer, nation), sink, new_path(spark, "ingest-checkpoint"))
    run.awaitTermination()
    return read_keyed(spark, sink).select("listing_id", "property_id", "city", "price")


@query(
    "keyed_sink",
    over("raw", """SELECT property_id, listing_id, city FROM raw
      QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY listing_id % 3 = 2, listing_id % 3, listing_id) = 1"""),
)
def keyed_sink(spark, folder):
    """A third of the listings, another third, then all of them twice: every key is taken from the first batch that has it."""
    raw = raw_listings(spark, folder).select("listing_id", "property_id", "city")
    path, third = new_path(spark, "keyed"), F.col("listing_id") % 3
    for part in (raw.where(third == 0), raw.where(third == 1), raw, raw):
        append_keyed(rows.first_per_key(part, ["property_id"]), path, "property_id")
    return read_keyed(spark, path).select("property_id", "listing_id", "city")


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, folder):
    """The delay covers the span of the table, so no first event comes too late, in whatever order files arrive."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    span = events.agg(F.date_diff(F.max(ts), F.min(ts))).first()[0] or 0
    arriving = ingest.landing_stream(spark, f"{folder}/events.parque[t]", events.schema)
    sink = new_path(spark, "unique-events")
    arriving = arriving.withColumn("ts", F.col("ts").cast("timestamp"))
    run = ingest.append_stream(ingest.unique_within(arriving, "event_id", "ts", f"{span + 1} days"), sink, new_path(spark, "dedup-checkpoint"))
    run.awaitTermination()
    return spark.read.parquet(sink).select("event_id")


FEED = """WITH days AS (SELECT *, date_diff('day', CAST(min(ts) OVER () AS DATE), CAST(ts AS DATE)) // 5 AS own FROM events),
feed AS (SELECT own AS file, * FROM days UNION ALL SELECT own + 1, * FROM days WHERE event_id % 7 = 0 AND own < 5
         UNION ALL SELECT own + 2, * FROM days WHERE event_id % 11 = 0 AND own < 4),
marks AS (SELECT file, max(max(epoch_ms(ts))) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000 AS mark FROM feed GROUP BY file),
told AS (SELECT event_id, file, coalesce(epoch_ms(ts) < mark, false) AS late FROM feed JOIN marks USING (file))
SELECT event_id, late, CASE WHEN late THEN count(*) ELSE 1 END AS n FROM told GROUP BY event_id, late"""


@query("late_rows", FEED)
def late_rows(spark, folder):
    """The events in files of five days, each with some of the two files before; with a delay of one day repeats are
    dropped or come out as late."""
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    first = events.agg(F.min("ts").cast("date")).scalar()
    days = events.select("event_id", "ts", "user_id", F.floor(F.date_diff(F.col("ts").cast("date"), first) / 5).alias("own"))
    landing = new_path(spark, "landing")
    for file in range(6):
        again = (F.col("own") == file - 1) & (F.col("event_id") % 7 == 0) | (F.col("own") == file - 2) & (F.col("event_id") % 11 == 0)
        days.where((F.col("own") == file) | again).drop("own").coalesce(1).write.mode("append").parquet(landing)
    arriving = ingest.landing_stream(spark, landing, days.drop("own").schema, maxFilesPerTrigger=1)
    path = new_path(spark, "told-apart")
    ingest.first_or_late(arriving, path, new_path(spark, "late-checkpoint"), "event_id", "ts", 86_400_000).awaitTermination()
    first, late = (ingest.read_told_apart(spark, path, part).withColumn("late", F.lit(part == "late")) for part in ("rows", "late"))
    return first.unionByName(late).groupBy("event_id", "late").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
