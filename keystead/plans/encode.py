"""Model features: one-hot categories without their first level, numbers to scale."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystead.storage import lookup_join


def fit_encoder(df: DataFrame, categorical: list[str], numeric: list[str], drop_first: bool = True) -> PipelineModel:
    """Transformers that turn the columns into a sparse ``features`` vector (A-M1).

    Levels are ordered so that the alphabetically first one comes last and is
    dropped. A level unknown at fitting gets the same all-zero code. Columns
    are read as text; the encoded names are in ``feature_names``.
    """
    if not categorical:
        return PipelineModel([VectorAssembler(inputCols=numeric, outputCol="features")])
    texts = ", ".join(f"CAST(`{c}` AS STRING) AS `text {c}`" for c in categorical)
    as_text = SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__")
    indexer = StringIndexer(
        inputCols=[f"text {c}" for c in categorical],
        outputCols=[f"raw index {c}" for c in categorical],
        stringOrderType="alphabetDesc",
        handleInvalid="keep",
    ).fit(as_text.transform(df))
    # The index of an unknown level is one above the last; it is moved onto the last.
    last = [len(labels) - 1 for labels in indexer.labelsArray]
    capped = ", ".join(f"least(`raw index {c}`, {n}D) AS `index {c}`" for c, n in zip(categorical, last))
    merge_unknown = SQLTransformer(statement=f"SELECT *, {capped} FROM __THIS__")
    indexed = merge_unknown.transform(indexer.transform(as_text.transform(df)))
    encoder = OneHotEncoder(
        inputCols=[f"index {c}" for c in categorical],
        outputCols=[f"code {c}" for c in categorical],
        dropLast=drop_first,
    ).fit(indexed)
    assembler = VectorAssembler(inputCols=[*numeric, *encoder.getOutputCols()], outputCol="features")
    return PipelineModel([as_text, indexer, merge_unknown, encoder, assembler])


def feature_names(encoder: PipelineModel, categorical: list[str], numeric: list[str]) -> list[str]:
    """Names of the vector positions: numbers, then ``column_level``."""
    levels = encoder.stages[1].labelsArray if categorical else []
    return [*numeric, *(f"{c}_{level}" for c, labels in zip(categorical, levels) for level in labels[:-1])]


def code_ranges(encoder: PipelineModel, categorical: list[str], first: int) -> list[range]:
    """The vector positions of each category, if the codes begin at ``first``."""
    ranges = []
    for labels in encoder.stages[1].labelsArray if categorical else []:
        ranges.append(range(first, first + len(labels) - 1))
        first = ranges[-1].stop
    return ranges


def drop_helpers(df: DataFrame) -> DataFrame:
    """Without the intermediate columns of the encoder."""
    helper = ("text ", "raw index ", "index ", "code ")
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith(helper)])


def _cells(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """The keys of a row, column, level: one row for every category of every row that has one."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    return df.select(*keys, F.explode(each).alias("cell")).select(*keys, "cell.*").where(F.col("level").isNotNull())


def level_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, level, position, feature of every known level, as a table; position 0 is the base level (A-M1).

    The base is the alphabetically first level of its column and has no feature.
    """
    known = _cells(df, columns).distinct()
    place = F.row_number().over(Window.partitionBy("column").orderBy("level")) - 1
    feature = F.when(F.col("position") > 0, F.concat_ws("_", "column", "level"))
    return known.withColumn("position", place).withColumn("feature", feature)


def one_hot(df: DataFrame, levels: DataFrame, columns: list[str], key: str = "listing_id") -> DataFrame:
    """key, feature, value of every 1 in the one-hot codes of the rows (A-M1, A-M9).

    Zeros have no row, so base levels, missing ones and levels that the table lacks have none either. The table of
    levels is joined by its size; it never passes the driver.
    """
    coded = levels.where(F.col("position") > 0).select("column", "level", "feature")
    found = lookup_join(_cells(df, columns, key), coded, ["column", "level"], "inner")
    return found.select(key, "feature", F.lit(1.0).alias("value"))
