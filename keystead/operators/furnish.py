"""Furnishing texts: item counts and three furnishing levels.

A text is a list of pieces (``2 Fan``), and an item counts wherever its name
occurs in one. There are few different pieces, so items are looked for in
those: items meet the pieces that hold their first letters in an equality join,
and what meets is compared letter by letter. Texts then join what is known of
their pieces. Counts are rows (text, item, n) and sparse vectors; no text is
held against the whole vocabulary and no list of it is built.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from keystead.functions.features import furnishing_items, item_number
from keystead.storage import lookup_join, materialise

#: Letters of an item by which it is looked up in the pieces.
SEED = 8
#: Most items of the lower two levels where levels go by the number of items.
BANDS = (2, 5)
ROWS_PER_TASK = 20_000


def vocabulary(df: DataFrame, text: str = "furnishDetails") -> DataFrame:
    """Distinct item names in all furnishing texts."""
    return df.select(F.explode(furnishing_items(F.col(text))).alias("item")).distinct()


def _seeds(piece: Column) -> Column:
    """All distinct substrings of a piece of up to ``SEED`` letters."""
    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: F.substr(piece, i, F.lit(n)))

    return F.when(F.length(piece) > 0, F.array_distinct(F.concat(*[of_length(n) for n in range(1, SEED + 1)])))


def piece_items(pieces: DataFrame, items: DataFrame) -> DataFrame:
    """piece, item, negated, numbered, number for every item whose name occurs in a piece.

    negated: the piece says that there is none; numbered, number: it says how many.
    """
    keyed = items.select("item", F.left("item", F.lit(SEED)).alias("seed"))
    met = pieces.select("piece", F.explode(_seeds(F.col("piece"))).alias("seed")).join(materialise(keyed, "items"), "seed")
    number = item_number(F.col("piece"), F.col("item"))
    return met.where(F.col("piece").contains(F.col("item"))).select(
        "piece",
        "item",
        F.col("piece").contains(F.concat(F.lit("No "), F.col("item"))).alias("negated"),
        (number != "").alias("numbered"),
        number.try_cast("int").alias("number"),
    )


def furnish_counts(df: DataFrame, key: str = "listing_id", text: str = "furnishDetails") -> DataFrame:
    """How often each listing names each vocabulary item; zero counts are left out.

    ``key`` is unique. The first number that a text gives for an item counts, wherever else the item occurs.
    """
    rows = df.select(key, F.posexplode(F.split(F.col(text), ", ")).alias("at", "piece"))
    known = piece_items(materialise(rows.select("piece").distinct(), "pieces"), vocabulary(df, text))
    found = lookup_join(rows, known, ["piece"], "inner")
    first = F.min(F.when(F.col("numbered"), F.struct("at", "number")))
    counted = found.groupBy(key, "item").agg(F.max("negated").alias("negated"), F.coalesce(first["number"], F.lit(1)).alias("n"))
    return counted.where(~F.col("negated") & (F.col("n") > 0)).select(key, "item", "n")


def item_total(text: Column) -> Column:
    """Number of items a text lists that are not said to be absent."""
    pieces = F.transform(F.split(F.regexp_replace(text, r"[\[\]']", ""), ", "), lambda x: F.btrim(x))
    return F.coalesce(F.size(F.filter(pieces, lambda x: (x != "") & ~x.startswith("No "))), F.lit(0))


def furnishing_band(text: Column) -> Column:
    """Furnishing level 0 to 2 by the number of items listed, where no clusters are wanted."""
    n = F.when(text.isNull(), F.lit(0)).otherwise(item_total(text))
    return F.when(n <= BANDS[0], 0).when(n <= BANDS[1], 1).otherwise(2)


def distinct_texts(df: DataFrame, text: str = "furnishDetails") -> DataFrame:
    """text, weight: every different text, null as the empty one, and how many listings have it; a written table."""
    details = F.coalesce(F.col(text), F.lit(""))
    return materialise(df.groupBy(details.alias("text")).agg(F.count(F.lit(1)).cast("double").alias("weight")), "texts")


def scaled_counts(texts: DataFrame) -> DataFrame:
    """text, weight, item, value: counts of ``distinct_texts`` in units of their deviation over the listings (A-M4).

    Values are not centred, which would fill the zeros and moves no distance. The deviation is that of the
    population; an item that does not vary is left out.
    """
    counts = materialise(furnish_counts(texts, "text", "text").join(texts, "text"), "furnish-counts")
    total = texts.agg(F.sum("weight")).scalar()
    mean, square = F.sum(F.col("n") * F.col("weight")) / total, F.sum(F.col("n") * F.col("n") * F.col("weight")) / total
    std = counts.groupBy("item").agg(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))
    scaled = counts.join(std.where("std > 1e-9"), "item")
    return scaled.select("text", "weight", "item", (F.col("n") / F.col("std")).alias("value"))


def count_vectors(texts: DataFrame) -> DataFrame | None:
    """text, weight, features: the scaled counts of ``distinct_texts`` as sparse vectors (P25); None without any item."""
    scaled = materialise(scaled_counts(texts), "furnish-scaled")
    items = scaled.select("item").distinct()
    # the vocabulary of a model whose centres have one number for each item
    numbered = materialise(items.withColumn("at", F.row_number().over(Window.orderBy("item")) - 1), "numbered-items")
    size = numbered.count()
    if size == 0:
        return None
    cells = F.sort_array(F.collect_list(F.struct("at", "value")))
    filled = scaled.join(numbered, "item").groupBy("text").agg(cells.alias("cells"))
    cells = F.coalesce("cells", F.array().cast("array<struct<at:int,value:double>>"))
    rows = texts.join(filled, "text", "left").select(
        "text",
        "weight",
        # how a sparse vector is stored
        F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), cells["at"].alias("indices"), cells["value"].alias("values")
        ).alias("features"),
    )
    path = materialise(rows.repartition(texts.count() // ROWS_PER_TASK + 1, "text"), "furnish-vectors").written_to
    schema = StructType().add("text", StringType()).add("weight", "double").add("features", VectorUDT())
    return texts.sparkSession.read.schema(schema).parquet(path)


def furnishing_levels(
    df: DataFrame, k: int = 3, seed: int = 42, text: str = "furnishDetails", starts: int = 10
) -> DataFrame:
    """Adds ``furnishing_type``: clusters of the item counts, 0 = barest (A-M5).

    Clusters are numbered by the sum of their centre, so that a higher number
    means more furnishing; rows are clustered by distinct text first because
    equal texts have equal counts. The best of ``starts`` starts is taken. Without
    any item every level is 0.
    """
    details = F.coalesce(F.col(text), F.lit(""))
    vectors = count_vectors(distinct_texts(df, text))
    # no more clusters than different texts, so that few texts still get levels
    k = 1 if vectors is None else min(k, vectors.count())
    if k == 1:
        return df.withColumn("furnishing_type", F.lit(0))

    def fit(start: int):
        return KMeans(k=k, seed=seed + start, weightCol="weight", maxIter=50).fit(vectors)

    with ThreadPool(starts) as pool:  # the starts are independent jobs
        fits = pool.map(fit, range(starts))
    model = min(fits, key=lambda fit: fit.summary.trainingCost)
    by_mass = sorted(range(len(model.clusterCenters())), key=lambda i: float(model.clusterCenters()[i].sum()))
    rank = F.array(*[F.lit(by_mass.index(i)) for i in range(len(by_mass))])
    levels = PipelineModel([model]).transform(vectors).select(
        F.col("text").alias("details"), F.get(rank, F.col("prediction")).alias("level")
    )
    # listings without a text all have one level, which needs no join
    bare = levels.where(F.col("details") == "").agg(F.max("level")).scalar()
    keyed = df.withColumn("details", F.when(details != "", details))
    found = lookup_join(keyed, levels.where(F.col("details") != ""), ["details"])
    level = F.when(F.col("details").isNull(), bare).otherwise(F.col("level"))
    return found.withColumn("furnishing_type", level).drop("details", "level")
