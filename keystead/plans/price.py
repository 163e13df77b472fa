"""Price models on the log price: a forest and boosted trees."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystead.functions.labels import FURNISHING_LABELS, implied_rate, log_price, price_band, price_from_log, recode
from keystead.functions.numeric import round_exact
from keystead.functions.place import city_of
from keystead.operators.rows import fold_of, is_held_out
from keystead.plans import boosting, store
from keystead.plans import forest as grown
from keystead.plans.encode import code_ranges, drop_helpers, fit_encoder
from keystead.storage import materialise

NUMBERS = ["bedRoom", "bathroom", "built_up_area", "servant room", "store room"]
CATEGORIES = ["property_type", "sector", "balcony", "agePossession", "furnishing_type", "luxury_category", "floor_category"]
ROWS_PER_TASK = 20_000
FITS_AT_ONCE = 8
# What a predict request may leave out.
REQUEST_DEFAULTS = {
    "servant room": 0,
    "store room": 0,
    "furnishing_type": "unfurnished",
    "luxury_category": "Low",
    "floor_category": "Mid Floor",
}


def training_frame(df: DataFrame) -> DataFrame:
    """Listings with readable furnishing and the label, the log price."""
    furnishing = F.col("furnishing_type")
    return df.withColumns({
        "furnishing_type": recode(furnishing.try_cast("int"), FURNISHING_LABELS, furnishing.cast("string")),
        "label": log_price(F.col("price")),
    })


def categorical_columns(df: DataFrame) -> list[str]:
    """The categories at hand, with the city if the table has one (A-M1)."""
    return [c for c in ["city", *CATEGORIES] if c in df.columns]


def forest(trees: int = 500, depth: int = 30, seed: int = 42) -> RandomForestRegressor:
    """Random forest: √features per split, three quarters of the rows per tree (A-M2)."""
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", subsamplingRate=0.75, seed=seed,
        maxMemoryInMB=512, cacheNodeIds=True,
    )


def boosted(trees: int = 500, seed: int = 42) -> GBTRegressor:
    """Boosted trees: depth 6, rate 0.05, 80 % of rows and features (A-M3)."""
    return GBTRegressor(maxIter=trees, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)


def fit(train: DataFrame, estimator: Estimator) -> PipelineModel:
    """Encoder, scaler and regressor fitted on labelled listings (A-M1, A-M4, A-M7)."""
    categories = categorical_columns(train)
    encoder = fit_encoder(train, categories, NUMBERS)
    *steps, _ = encoder.stages
    numbers = VectorAssembler(inputCols=NUMBERS, outputCol="numbers")
    encoded = PipelineModel([*steps, numbers]).transform(train)
    scaler = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True).fit(encoded)
    features = VectorAssembler(inputCols=["scaled", *[f"code {c}" for c in categories]], outputCol="features")
    rows = features.transform(scaler.transform(encoded))
    regressor, sizes = None, grown.forest_of(estimator) if isinstance(estimator, RandomForestRegressor) else None
    if sizes:
        kept = [c for c in ("listing_id", "label", "features") if c in rows.columns]
        regressor = grown.fit(_dealt(rows.select(*kept)), sizes, code_ranges(encoder, categories, len(NUMBERS)))
    return PipelineModel([*steps, numbers, scaler, features, regressor or estimator.fit(rows)])


def _dealt(rows: DataFrame) -> DataFrame:
    """A written table in as many tasks as its rows give work."""
    rows = materialise(rows, "encoded")
    tasks, keys = rows.count() // ROWS_PER_TASK + 1, [c for c in ("listing_id",) if c in rows.columns]
    dealt = rows.repartition(tasks, *keys)
    return materialise(dealt.sortWithinPartitions(*keys) if keys else dealt, "encoded")


def _outcome(model: PipelineModel, rows: DataFrame) -> tuple[float, float, float]:
    """R² of the log price, R² of the price, and mean absolute error of the price."""
    scored = model.transform(rows).select("label", "prediction")
    y, z = F.col("label"), F.col("prediction")
    price, guess = price_from_log(y), price_from_log(z)
    sums = scored.agg(
        F.sum((y - z) ** 2).alias("se"), (F.var_pop(y) * F.count(y)).alias("st"),
        F.sum((price - guess) ** 2).alias("pse"), (F.var_pop(price) * F.count(y)).alias("pst"),
        F.avg(F.abs(price - guess)).alias("mae"),
    ).first()
    return 1 - sums["se"] / sums["st"], 1 - sums["pse"] / sums["pst"], sums["mae"]


def encoded(df: DataFrame, folds: int = 10) -> DataFrame:
    """listing_id, label, fold, held_out, features: encoded once and written, for every fit of a comparison (A-M1, A-M6).

    Levels that only a fold's test rows have are columns without a value in its training rows, which no model
    uses: they count as the base level, as if the encoder had been fitted on the fold. The table is dealt by the
    number of its rows, so a fit runs in as many tasks as it has work for.
    """
    train = training_frame(df)
    categories = categorical_columns(train)
    encoder = fit_encoder(train, categories, NUMBERS)
    *steps, _ = encoder.stages
    numbers = VectorAssembler(inputCols=NUMBERS, outputCol="numbers")
    coded = PipelineModel([*steps, numbers]).transform(train)
    scaler = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True).fit(coded)
    features = VectorAssembler(inputCols=["scaled", *[f"code {c}" for c in categories]], outputCol="features")
    rows = features.transform(scaler.transform(coded)).withColumns({"fold": fold_of(folds=folds), "held_out": is_held_out()})
    out = _dealt(rows.select("listing_id", "label", "fold", "held_out", "features"))
    out.groups = code_ranges(encoder, categories, len(NUMBERS))
    return out


def fold_outcomes(rows: DataFrame, estimators: dict[str, Estimator], folds: int = 10) -> dict[str, list[tuple[float, float, float]]]:
    """Outcomes of every estimator on each fold and, last, on the held-out fifth (A-M6).

    The fits do not depend on each other: forests and boosted trees are trained for all folds in one stage, by tasks
    that hold the rows. Other estimators, and forests on more rows than a task holds, are fitted side by side: while
    one waits for the driver between two of its many small jobs, the tasks of others run.
    """
    tests = [F.col("fold") == fold for fold in range(folds)] + [F.col("held_out")]
    groups = getattr(rows, "groups", [])

    def together(estimator: Estimator) -> list[tuple[float, float, float]] | None:
        if isinstance(estimator, GBTRegressor):
            return boosting.fold_outcomes(rows, tests, boosting_of(estimator), groups)
        sizes = grown.forest_of(estimator) if isinstance(estimator, RandomForestRegressor) else None
        return grown.fold_outcomes(rows, tests, sizes, groups) if sizes else None

    def one(job: tuple[str, int]) -> tuple[float, float, float]:
        name, fold = job
        test = tests[fold]
        model = estimators[name].copy().fit(rows.where(~test))
        return _outcome(model, rows.where(test))

    with ThreadPool(FITS_AT_ONCE) as pool:
        started = {name: pool.apply_async(together, (e,)) for name, e in estimators.items()}
        whole = {name: got.get() for name, got in started.items()}
        jobs = [(name, fold) for name in estimators if whole[name] is None for fold in range(folds + 1)]
        found = dict(zip(jobs, pool.map(one, jobs, chunksize=1), strict=True))
    return {name: whole[name] or [found[name, fold] for fold in range(folds + 1)] for name in estimators}


def boosting_of(estimator: GBTRegressor) -> boosting.Boosting:
    """The same sizes for the trainer of all folds."""
    return boosting.Boosting(
        trees=estimator.getMaxIter(), depth=estimator.getMaxDepth(), rate=estimator.getStepSize(), rows=estimator.getSubsamplingRate(),
        columns=float(estimator.getFeatureSubsetStrategy()), seed=estimator.getSeed(), bins=estimator.getMaxBins(),
    )


def cv_score(train: DataFrame, estimator: Estimator, folds: int = 10) -> tuple[float, float, float]:
    """Mean and deviation of R² over folds, and the error on a held-out fifth in crore (A-M6)."""
    return _score(fold_outcomes(encoded(train, folds), {"": estimator}, folds)[""])


def _score(outcomes: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    r2 = [one[0] for one in outcomes[:-1]]
    return float(np.mean(r2)), float(np.std(r2)), outcomes[-1][2]


def compare(df: DataFrame, estimators: dict[str, Estimator], folds: int = 10) -> DataFrame:
    """One row per model with its scores, the winner by mean R² marked (A-M7)."""
    found = fold_outcomes(encoded(df, folds), estimators, folds)
    rows = [(name, *_score(outcomes)) for name, outcomes in found.items()]
    best = max(rows, key=lambda r: r[1])[0]
    return df.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows], "model string, r2_mean double, r2_std double, mae double, winner boolean"
    )


def fit_final(df: DataFrame, estimator: Estimator) -> tuple[PipelineModel, DataFrame]:
    """The model on all rows, and one row with its training R² and error (A-M7)."""
    train = materialise(training_frame(df), "training")
    model = fit(train, estimator)
    _, r2, mae = _outcome(model, train)
    return model, df.sparkSession.createDataFrame([(r2, mae)], "train_r2 double, train_mae double")


def expects_city(model: PipelineModel) -> bool:
    """Whether the model was fitted with the city."""
    first = model.stages[0]
    return isinstance(first, SQLTransformer) and "`city`" in first.getStatement()


def predict(model: PipelineModel, requests: DataFrame) -> DataFrame:
    """``predicted_price`` in crore for every row, with its 10 % range and rate (A-M8, P37).

    Absent columns take their defaults; an absent city is told from the sector.
    """
    absent = {c: F.lit(v) for c, v in REQUEST_DEFAULTS.items() if c not in requests.columns}
    rows = requests.withColumns(absent) if absent else requests
    if expects_city(model):
        given = F.col("city") if "city" in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn("city", F.coalesce(given, city_of(F.col("sector"))))
    furnishing = F.col("furnishing_type")
    rows = rows.withColumn("furnishing_type", recode(furnishing.try_cast("int"), FURNISHING_LABELS, furnishing.cast("string")))
    scored = drop_helpers(model.transform(rows))
    price = round_exact(price_from_log(F.col("prediction")), 2)
    priced = scored.withColumn("predicted_price", price).drop("numbers", "scaled", "features", "prediction", "label")
    return priced.withColumns({
        "likely": price_band(F.col("predicted_price")),
        "rate": implied_rate(F.col("predicted_price"), F.col("built_up_area")),
    })


def load_or_fit(spark: SparkSession, path: str, df: DataFrame, estimator: Estimator) -> PipelineModel:
    """The saved model, or a new one fitted and saved if there is none."""
    return store.load_or_fit(spark, path, lambda: fit_final(df, estimator)[0])
