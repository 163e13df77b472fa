"""Similar listings by three weighted cosine signals.

The full matrix of pairs is never built. One anchor is scored in one scan; a
table of anchors meets chunks of the listings, of each of which only the best n
rows per anchor are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystead.functions.numeric import round_exact
from keystead.operators.quantiles import medians
from keystead.operators.rows import select_listings
from keystead.storage import materialise

NUMERIC = ["price", "bedRoom", "bathroom", "built_up_area", "servant room", "store room"]
CATEGORICAL = ["property_type", "agePossession", "furnishing_type", "luxury_category", "floor_category", "balcony"]
LOCATION = ["sector", "city"]
WEIGHTS = (30.0, 20.0, 8.0)
ANCHOR_BLOCK = 256
CHUNK_ROWS = 20_000


def with_scores(df: DataFrame) -> DataFrame:
    """Adds ``z``, the z-scores of a listing, and ``norm``, their length (A-M4, A-M14).

    The deviation is that of the population, NULL counts as 0, and a constant
    column gives 0. Numeric columns that the table lacks are left out.
    """
    numeric = [c for c in NUMERIC if c in df.columns]
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    stats = df.agg(
        F.struct(
            *[F.avg(v).alias(f"mean {c}") for c, v in value.items()],
            *[F.stddev_pop(v).alias(f"std {c}") for c, v in value.items()],
        )
    )
    scores = [
        F.when(F.col("stats")[f"std {c}"] > 0, (v - F.col("stats")[f"mean {c}"]) / F.col("stats")[f"std {c}"])
        .otherwise(F.lit(0.0))
        .alias(c)
        for c, v in value.items()
    ]
    length = reduce(lambda a, b: a + b, [F.col("z")[c] * F.col("z")[c] for c in numeric])
    return (
        df.withColumn("stats", stats.scalar())
        .withColumn("z", F.struct(*scores))
        .withColumn("norm", F.sqrt(length))
        .drop("stats")
    )


def _shared(columns: list[str], anchor: Column) -> Column:
    """Share of columns equal in both rows: the cosine of their one-hot codes (A-M15, A-M16)."""
    equal = [F.col(c).eqNullSafe(anchor[c]).cast("double") for c in columns]
    return reduce(lambda a, b: a + b, equal) / len(columns)


def similarity(anchor: Column, columns: list[str]) -> tuple[Column, Column, Column]:
    """Numeric, categorical and location cosine with an anchor struct, over the columns at hand."""
    dot = reduce(lambda a, b: a + b, [F.col("z")[c] * anchor["z"][c] for c in NUMERIC if c in columns])
    lengths = F.col("norm") * anchor["norm"]
    numeric = F.when(lengths > 0, dot / lengths).otherwise(F.lit(0.0))
    categorical = [c for c in CATEGORICAL if c in columns]
    return numeric, _shared(categorical, anchor), _shared(LOCATION, anchor)


def recommend(
    df: DataFrame,
    listing_id: int,
    top_n: int = 5,
    same_city_only: bool = False,
    weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """The ``top_n`` listings most like one listing, with rank and score (A-M17, A-M18, T1, W2)."""
    if df.where(F.col("listing_id") == listing_id).isEmpty():
        raise ValueError(f"no listing {listing_id}")
    scored = with_scores(df)
    parts = F.struct("z", "norm", *[c for c in CATEGORICAL + LOCATION if c in df.columns])
    anchor = scored.where(F.col("listing_id") == listing_id).agg(F.first(parts)).scalar()
    others = scored.where(F.col("listing_id") != listing_id).withColumn("anchor", anchor)
    if same_city_only:
        others = others.where(F.col("city") == F.col("anchor.city"))
    signals = similarity(F.col("anchor"), df.columns)
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * s for w, s in zip(weights, signals)])
    top = others.withColumn("score", total).orderBy(F.desc("score"), "listing_id").limit(top_n)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "listing_id"))
    return top.select(place.alias("Rank"), *df.columns, round_exact(F.col("score"), 4).alias("SimilarityScore"))


def median_anchor(candidates: DataFrame) -> int | None:
    """Id of the listing whose price is closest to the median, None without candidates."""
    mid = medians(candidates, [], {"m": "price"}).scalar()
    distance = F.abs(F.col("price") - F.col("mid"))
    row = candidates.select("listing_id", "price").withColumn("mid", mid).orderBy(distance, "listing_id").first()
    return None if row is None else row["listing_id"]


def recommend_by_filters(
    df: DataFrame,
    city: str | None = None,
    sector: str | None = None,
    property_type: str | None = None,
    bedrooms: int | None = None,
    budget_max: float | None = None,
    top_n: int = 5,
    weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """Neighbours of the median-priced listing that meets the filters; empty if none does (A-M18)."""
    anchor = median_anchor(select_listings(df, city, sector, property_type, bedrooms, budget_max))
    if anchor is None:
        result = df.select(F.lit(0).alias("Rank"), *df.columns, F.lit(0.0).alias("SimilarityScore"))
        return result.where(F.lit(False))
    return recommend(df, anchor, top_n, bool(city), weights)


def group_anchors(df: DataFrame, keys: list[str]) -> DataFrame:
    """The median-priced listing of every group (W4 per group)."""
    mid = materialise(medians(df, keys, {"mid": "price"}), "group-medians")
    distance = F.abs(F.col("price") - F.col("mid"))
    return df.join(mid, keys).groupBy(*keys).agg(
        F.min(F.struct(distance.alias("distance"), F.col("listing_id").alias("listing_id"))).alias("best")
    ).select(F.col("best.listing_id").alias("anchor_id"))


def similar_to_each(
    df: DataFrame,
    anchors: DataFrame,
    top_n: int = 5,
    weights: tuple[float, float, float] = WEIGHTS,
) -> DataFrame:
    """The ``top_n`` neighbours of every listing named in ``anchors``.

    Listings are dealt into chunks of about ``CHUNK_ROWS`` rows, and every anchor goes to every chunk once: one
    shuffle and one plan, however many anchors there are. A task holds one chunk and lets the anchors stream past
    it in blocks of ``ANCHOR_BLOCK``; of the pairs only the best n of an anchor and a chunk leave the task.
    """
    labels = [c for c in CATEGORICAL + LOCATION if c in df.columns]
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in labels]
    scored = materialise(with_scores(df).select("listing_id", "z.*", "norm", *texts), "scored")
    ids = anchors.select(F.col("anchor_id").alias("listing_id")).distinct()
    chunks = scored.count() // CHUNK_ROWS + 1
    dealt = scored.withColumns({"chunk": F.pmod(F.xxhash64("listing_id"), F.lit(chunks)), "is_anchor": F.lit(False)})
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>"))
    picked = scored.join(ids, "listing_id", "left_semi").withColumns({"chunk": every, "is_anchor": F.lit(True)})
    together = dealt.unionByName(picked).repartition(chunks, "chunk").sortWithinPartitions("chunk", "is_anchor", "listing_id")
    found = together.mapInPandas(_best_per_chunk(top_n, weights), "anchor_id bigint, listing_id bigint, score double")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "listing_id")
    return (
        found.withColumn("Rank", F.row_number().over(order))
        .where(F.col("Rank") <= top_n)
        .select("anchor_id", "Rank", "listing_id", round_exact(F.col("score"), 4).alias("SimilarityScore"))
    )


class Chunk:
    """Listings that a task holds, ready to be compared with blocks of anchors."""

    def __init__(self, rows: pd.DataFrame, top_n: int, weights: tuple[float, float, float]) -> None:
        self.ids, self.top_n, self.weights = rows["listing_id"].to_numpy(), top_n, weights
        self.measures = [c for c in NUMERIC if c in rows.columns]
        self.directions = self.unit(rows)
        self.known = {c: pd.Index(rows[c].unique()) for c in CATEGORICAL + LOCATION if c in rows.columns}
        self.codes = {c: index.get_indexer(rows[c]) for c, index in self.known.items()}

    def unit(self, rows: pd.DataFrame) -> np.ndarray:
        length = rows["norm"].to_numpy()[:, None]
        return np.divide(rows[self.measures].to_numpy(), length, out=np.zeros((len(rows), len(self.measures))), where=length > 0)

    def shared(self, anchors: pd.DataFrame, columns: list[str]) -> np.ndarray:
        """Share of equal labels; a label that no listing of the chunk has equals none."""
        columns = [c for c in columns if c in self.known]
        equal = [self.codes[c][:, None] == self.known[c].get_indexer(anchors[c])[None, :] for c in columns]
        return np.sum(equal, axis=0) / len(columns)

    def best(self, anchors: pd.DataFrame) -> pd.DataFrame:
        """The best rows of the chunk for every anchor, ties with the last of them included."""
        ids = anchors["listing_id"].to_numpy()
        numeric, categorical, location = self.weights
        score = numeric * (self.directions @ self.unit(anchors).T)
        score += categorical * self.shared(anchors, CATEGORICAL) + location * self.shared(anchors, LOCATION)
        score[self.ids[:, None] == ids[None, :]] = -np.inf
        kept = np.isfinite(score)
        if len(score) > self.top_n:
            kept &= score >= np.partition(score, len(score) - self.top_n, axis=0)[len(score) - self.top_n]
        row, anchor = np.nonzero(kept)
        found = pd.DataFrame({"anchor_id": ids[anchor], "listing_id": self.ids[row], "score": score[row, anchor]})
        ranked = found.sort_values(["score", "listing_id"], ascending=[False, True])
        return ranked.groupby("anchor_id", sort=False).head(self.top_n)


def _best_per_chunk(top_n: int, weights: tuple[float, float, float]):
    """A ``mapInPandas`` function over rows sorted by chunk, listings before anchors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        number, chunk = None, None
        for batch in batches:
            for (at, is_anchor), rows in batch.groupby(["chunk", "is_anchor"], sort=True):
                if at != number:
                    number, chunk, held = at, None, []
                if not is_anchor:
                    held.append(rows)
                elif held:
                    chunk = chunk or Chunk(pd.concat(held), top_n, weights)
                    for first in range(0, len(rows), ANCHOR_BLOCK):
                        yield chunk.best(rows.iloc[first : first + ANCHOR_BLOCK])

    return run
