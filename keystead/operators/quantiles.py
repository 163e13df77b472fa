"""Exact quantiles of groups of any size.

``median`` and ``percentile`` keep every distinct value of a group in one task.
Here equal values of a group are counted first, on (group, value), so a hot
value or a hot group is already reduced before the shuffle. No task then
holds more than a narrow band of one group, whatever the size of the table:

1. values are put into bands of about 0.1 % relative width, and the running
   total over the bands of a group tells which band holds each wanted rank;
2. only the values of those bands are ordered, after one finer division.

The bands are a fixed monotone function of the value, so the result does not
depend on partitioning, sampling or retries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystead.storage import lookup_join, materialise

COARSE = 1024.0
FINE = 65536.0
TARGET = ["out", "low_rank", "high_rank", "part"]


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Linearly interpolated quantiles per group (all rows if ``keys`` is empty).

    ``wanted`` maps each output column to (input column, probability). NULL and
    NaN are left out; a NULL key forms no group, and a group without any value
    is absent.
    """
    columns = sorted({column for column, _ in wanted.values()})
    measures = F.explode(
        F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])
    )
    group = [*keys, "measure"]
    counts = (
        df.select(*keys, measures.alias("m"))
        .select(*keys, "m.measure", "m.v")
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True)))
        .groupBy(*group, "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = _holders_by_bands(materialise(counts, "value-counts"), group, wanted)

    def at(rank: str) -> Column:
        return F.max(F.when(_holds(rank), F.col("v")))

    found = ranked.groupBy(*group, *TARGET).agg(at("low_rank").alias("low"), at("high_rank").alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    outputs = [F.max(F.when(F.col("out") == name, value)).alias(name) for name in wanted]
    return found.groupBy(*keys).agg(*outputs)


def _holders(counts: DataFrame, group: list[str], order: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """The entries of (group…, order, n) that hold a wanted rank, once per target."""
    targets = F.array(
        *[
            F.struct(F.lit(out).alias("out"), F.lit(column).alias("of"), F.lit(float(p)).alias("p"))
            for out, (column, p) in wanted.items()
        ]
    )
    total = F.sum("n").over(Window.partitionBy(*group))
    rank = (F.col("total") - 1) * F.col("t.p")
    return (
        _running(counts, group, order, F.lit(0))
        .withColumn("total", total)
        .withColumn("t", F.explode(F.filter(targets, lambda t: t["of"] == F.col("measure"))))
        .select(
            *group, order, "n", "before",
            F.col("t.out").alias("out"),
            F.floor(rank).alias("low_rank"),
            F.ceil(rank).alias("high_rank"),
            (rank - F.floor(rank)).alias("part"),
        )
        .where(_holds("low_rank") | _holds("high_rank"))
    )


def _holders_by_bands(counts: DataFrame, group: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """The same as ``_holders`` on values, with no window wider than a narrow band of values."""
    position = F.signum("v") * F.log1p(F.abs("v")) * F.lit(COARSE)
    counts = counts.withColumn("coarse", F.floor(position)).withColumn(
        "fine", F.floor((position - F.col("coarse")) * F.lit(FINE))
    )
    coarse = _holders(counts.groupBy(*group, "coarse").agg(F.sum("n").alias("n")), group, "coarse", wanted)
    # The chosen bands are a few rows per group: the counts are filtered by them
    # without a shuffle, and what is left is about a thousandth of each group.
    in_band = materialise(lookup_join(counts, coarse.drop("n"), [*group, "coarse"], "inner"), "bands")
    band = [*group, *TARGET, "coarse"]
    holds = _holds("low_rank") | _holds("high_rank")
    fine = in_band.groupBy(*band, "before", "fine").agg(F.sum("n").alias("n"))
    fine = _running(fine, band, "fine", F.col("before")).where(holds)
    values = in_band.drop("before").join(fine.drop("n"), [*band, "fine"])
    return _running(values, [*band, "fine"], "v", F.col("before")).where(holds)


def medians(df: DataFrame, keys: list[str], wanted: dict[str, str]) -> DataFrame:
    """Exact medians per group; ``wanted`` maps output columns to input columns."""
    return quantiles(df, keys, {out: (column, 0.5) for out, column in wanted.items()})


def _running(df: DataFrame, group: list[str], order: str, start: Column) -> DataFrame:
    """Adds ``before``: how many rows of the group precede this entry."""
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", start + F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _holds(rank: str) -> Column:
    """The entry covers this rank, counted from 0."""
    return (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("n"))
