"""Reading raw listing files and writing stage tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystead.schemas import HOUSE_RENAMES, RAW_TEXTS, raw_schema
from keystead.storage import read_if_present, spread

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"'}


def read_raw_csv(spark: SparkSession, path: str, kind: str = "flat") -> DataFrame | None:
    """A raw listing file, every column as text and blanks as ``''``.

    Columns go by the names in the header, in any order; one that the file
    lacks is ``''`` throughout.

    Descriptions hold line breaks, so each file is read by one task; a large
    source should be a folder of many files. None if the path does not exist.
    """
    raw = read_if_present(spark, path, None, "csv", **CSV_OPTIONS)
    if raw is None:
        return None
    held = {name.strip(): name for name in raw.columns}
    named = [
        F.coalesce(F.col(f"`{held[name]}`"), F.lit("")).alias(name) if name in held else F.lit("").alias(name)
        for name in raw_schema(kind).names
    ]
    return raw.select(*named)


def unified(raw: DataFrame, kind: str, city: str) -> DataFrame:
    """Flats and houses in one shape, tagged with their source (S4, H10 undone).

    ``rate`` is the price-per-square-foot text, which flats call ``area``.
    """
    if kind == "house":
        raw = raw.withColumnsRenamed({"noOfFloor": "floorNum"})
    else:
        raw = raw.withColumnsRenamed({"area": "rate"})
    wanted = [HOUSE_RENAMES["area"] if c == "area" else c for c in RAW_TEXTS]
    present = set(raw.columns)
    texts = [F.col(c) if c in present else F.lit("").alias(c) for c in wanted]
    ids = [F.col("listing_id")] if "listing_id" in present else []
    return raw.select(*ids, *texts, F.lit(kind).alias("property_type"), F.lit(city).alias("city"))


def read_sources(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """All (path, kind, city) sources that exist, as one table; an error if none does."""
    found = [(read_raw_csv(spark, path, kind), kind, city) for path, kind, city in sources]
    parts = [unified(raw, kind, city) for raw, kind, city in found if raw is not None]
    if not parts:
        raise FileNotFoundError("none of the listing sources exists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_listing_id(df: DataFrame) -> DataFrame:
    """Adds a ``listing_id`` in arrival order, where a source brings none.

    The numbers are unique and grow along the files; write the result before
    it is read twice, because they are drawn anew on every run.
    """
    return df.withColumn("listing_id", F.monotonically_increasing_id())


def read_stage(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A stage table with its declared types."""
    options = CSV_OPTIONS if fmt == "csv" else {}
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def write_stage(df: DataFrame, path: str) -> None:
    """Replace a stage table (S3)."""
    df.write.mode("overwrite").parquet(path)


def write_by_city_and_kind(df: DataFrame, path: str, kind: str = "property_type") -> None:
    """One folder per city and listing kind; folders of other cities and kinds stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city", kind).parquet(path)


def append_by_city_and_kind(df: DataFrame, path: str, kind: str = "property_type", key: str = "property_id") -> None:
    """Append to each city's and kind's folder the rows whose key that folder lacks."""
    place = ["city", kind, key]
    known = read_if_present(df.sparkSession, path)
    fresh = df if known is None else _without(df, known.select(*place), place)
    fresh.write.mode("append").partitionBy("city", kind).parquet(path)


def _without(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys, null included, ``known`` does not have."""
    named = known.select(*[F.col(k).alias(f"known {k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"known {k}")) for k in keys]
    return new.join(named, same, "left_anti")


def stored_keys(spark: SparkSession, path: str, key: str = "property_id") -> DataFrame | None:
    """The distinct keys in a stored table, reading that column only."""
    table = read_if_present(spark, path)
    return None if table is None else table.select(key).distinct()


def unseen(new: DataFrame, known: DataFrame, key: str = "property_id") -> DataFrame:
    """New rows whose key, null included, is not stored yet."""
    return _without(new, known, [key])


def append_new(new: DataFrame, path: str, key: str = "property_id") -> None:
    """Append the rows whose key the table at ``path`` lacks."""
    known = read_if_present(new.sparkSession, path)
    fresh = new if known is None else unseen(new, known, key)
    fresh.write.mode("append").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored web pages, one row per page."""
    return spread(spark.read.schema("page_id bigint, url string, html string").parquet(path), "page_id")
