"""Row filters, keyed de-duplication, sampling and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystead.functions.text import is_blank
from keystead.storage import lookup_join, materialise

#: Random order is counted in 2^BAND_BITS bands.
BAND_BITS = 12
CORE_TEXTS = ["price", "bedRoom", "areaWithType"]


def first_per_key(df: DataFrame, keys: list[str], order: str = "listing_id") -> DataFrame:
    """The earliest row of every key (W1); ``order`` is unique, and null keys are a key.

    Whole rows stay where they are. Only keys and ids are grouped, each task keeping one id per key before the
    shuffle; the ids that lose, few in most tables, are then taken out of the rows. A key that holds much of the
    table (blank ids) is one row after the grouping, and its losing ids are as unique as all others. ``df`` is read
    twice, so it should be a written table.
    """
    names = [f"key {i}" for i in range(len(keys))]
    narrow = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(order).alias("lost id"))
    narrow = materialise(narrow, "keys")
    firsts = narrow.groupBy(*[F.col(n).alias(f"of {n}") for n in names]).agg(
        F.min("lost id").alias("first id"), F.count(F.lit(1)).alias("rows of key")
    )
    firsts = materialise(firsts.where(F.col("rows of key") > 1).drop("rows of key"), "first-ids")
    same = [F.col(n).eqNullSafe(F.col(f"of {n}")) for n in names]
    lost = narrow.join(firsts, same, "inner").where(F.col("lost id") > F.col("first id")).select("lost id")
    lost = materialise(lost, "lost-ids")
    return df.join(lost, F.col(order) == F.col("lost id"), "left_anti")


def first_of_computed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The earliest row of every key where rows are costly to compute or their order is not unique.

    One aggregate over whole rows: they are computed once and shuffled once, each task keeping one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"))
    return kept.select(*keys, "row.*").select(*df.columns)


def distinct_rows(df: DataFrame, order: str = "listing_id") -> DataFrame:
    """Rows that differ in anything but their id; the smallest id stays."""
    content = [c for c in df.columns if c != order]
    return df.groupBy(*content).agg(F.min(order).alias(order)).select(*df.columns)


def has_core_text(facts: Column | None = None) -> Column:
    """Price, bedroom or area text is there, or will be once recovered from ``facts`` (F1 negated).

    The texts come first, so the description is looked at only where all are blank.
    """
    tests = [~is_blank(F.col(c)) for c in CORE_TEXTS] + ([] if facts is None else _stated(facts))
    return reduce(lambda a, b: a | b, tests)


def _stated(facts: Column) -> list[Column]:
    return [facts[f]["min"].isNotNull() for f in ("bed", "price", "area")]


def is_empty_listing(facts: Column, area_text: Column | None = None) -> Column:
    """No price, bedroom or area text and nothing parseable in the description (F2)."""
    texts = [F.col(c) for c in CORE_TEXTS] + ([] if area_text is None else [area_text])
    return ~reduce(lambda a, b: a | b, [~is_blank(c) for c in texts] + _stated(facts))


def frequent_groups(df: DataFrame, key: str, at_least: int = 3) -> DataFrame:
    """Rows whose group has at least ``at_least`` members (F8)."""
    large = df.groupBy(key).count().where(F.col("count") >= at_least).select(key)
    return lookup_join(df, large, [key], "left_semi")


def with_group_size(df: DataFrame, key: str, name: str = "group_size") -> DataFrame:
    """Rows with the number of rows of their group; a null key has its own group."""
    sizes = df.groupBy(F.col(key).alias("size_of")).agg(F.count(F.lit(1)).alias(name))
    sizes = materialise(sizes, "group-sizes")
    return df.join(sizes, F.col(key).eqNullSafe(F.col("size_of")), "left").drop("size_of")


def select_listings(
    df: DataFrame,
    city: str | None = None,
    sector: str | None = None,
    property_type: str | None = None,
    bedrooms: int | None = None,
    budget_max: float | None = None,
) -> DataFrame:
    """Rows meeting every given condition; an absent one does not filter."""
    equal = {"city": city, "sector": sector, "property_type": property_type, "bedRoom": bedrooms}
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    return df.where(F.col("price") <= budget_max) if budget_max else df


def reject_rows(df: DataFrame, bad_rows: DataFrame, key: str = "listing_id") -> DataFrame:
    """Rows not on the list of known bad ones."""
    return lookup_join(df, bad_rows.select(key), [key], "left_anti")


def without_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose name starts with none of the prefixes."""
    return reduce(lambda d, p: d.where(~F.col(column).startswith(p)), prefixes, df)


def keyed_hash(key: str = "listing_id", seed: int = 42) -> Column:
    """A whole number below 2^60 from a seed and a row's key; any engine with MD5 gets the same one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def random_places(df: DataFrame, key: str = "listing_id", seed: int = 42, first: int | None = None) -> DataFrame:
    """Adds ``place``, 1 to n: the rows in a repeatable random order, or only the ``first`` ones of it.

    The order is that of a hash of the key. Rows are counted in bands of equal width; the running total over the
    bands, a table of fixed size, says where a band begins, and only a band is ever ordered. Bands behind the
    last wanted place are left out before that.
    """
    hashed = df.withColumn("drawn", keyed_hash(key, seed)).withColumn("band", F.shiftright("drawn", 60 - BAND_BITS))
    totals = hashed.groupBy("band").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    if first is not None:
        starts = starts.where(F.col("before") < first)
    found = hashed.join(materialise(starts, "bands"), "band")
    inside = F.row_number().over(Window.partitionBy("band").orderBy("drawn", key))
    placed = found.withColumn("place", F.col("before") + inside).select(*df.columns, "place")
    return placed if first is None else placed.where(F.col("place") <= first)


def seeded_sample(df: DataFrame, n: int, key: str = "listing_id", seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones on every run and partitioning."""
    return random_places(df, key, seed, n).select(*df.columns)


def shuffled(df: DataFrame, key: str = "listing_id", seed: int = 42) -> DataFrame:
    """All rows in a repeatable random order (T5)."""
    return random_places(df, key, seed).orderBy("place").select(*df.columns)


def fold_of(key: str = "listing_id", folds: int = 10, seed: int = 42) -> Column:
    """Cross-validation fold of a row, from its id."""
    return (keyed_hash(key, seed) % folds).cast("int")


def is_held_out(share: float = 0.2, key: str = "listing_id", seed: int = 42) -> Column:
    """Whether a row belongs to the held-out share, independent of its fold."""
    return keyed_hash(key, seed + 1) % 1000 < int(share * 1000)


def holdout(df: DataFrame, share: float = 0.2, key: str = "listing_id", seed: int = 42):
    """Training and test rows, split by a hash of the id."""
    test = is_held_out(share, key, seed)
    return df.where(~test), df.where(test)
