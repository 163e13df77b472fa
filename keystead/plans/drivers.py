"""What drives the price: a linear model on standardised features per city."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystead.functions.labels import AGE_GROUPS, FURNISHING_CODES, LUXURY_CODES, PROPERTY_TYPE_CODES, log_price, recode
from keystead.functions.numeric import round_exact
from keystead.operators.rows import fold_of, select_listings
from keystead.plans.encode import feature_names, fit_encoder
from keystead.storage import materialise

ENCODED = ["sector", "agePossession"]
UNUSED = ["store room", "floor_category", "balcony"]
NUMBERS = ["property_type", "bedRoom", "bathroom", "built_up_area", "servant room", "furnishing_type", "luxury_category"]
NORMAL_LIMIT = 4096  # features that the normal equations of MLlib take
TOLERANCE, STEPS = 1e-10, 2000  # of the iterative solver


@dataclass
class DriverModel:
    """A fit on raw features with what is needed to read it on the standardised scale."""

    model: LinearRegressionModel
    rows: DataFrame
    names: list[str]
    means: np.ndarray
    stds: np.ndarray
    n: int

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    @property
    def coefficients(self) -> np.ndarray:
        """Effect of one standard deviation of each feature on the log price."""
        return self.model.coefficients.toArray() * self.stds


def driver_features(df: DataFrame) -> DataFrame:
    """Ordinal codes, three age groups and the log price, before encoding (A-M9, P34, P35)."""
    furnishing = recode(F.col("furnishing_type").cast("string"), FURNISHING_CODES, F.col("furnishing_type").try_cast("int"))
    return df.drop(*UNUSED).withColumns({
        "agePossession": recode(F.col("agePossession"), AGE_GROUPS, F.col("agePossession")),
        "property_type": recode(F.col("property_type"), PROPERTY_TYPE_CODES),
        "luxury_category": recode(F.col("luxury_category"), LUXURY_CODES),
        "furnishing_type": furnishing,
        "label": log_price(F.col("price")),
    })


def encoded_rows(
    df: DataFrame, city: str | None = None, numbers: list[str] = NUMBERS, encoded: list[str] = ENCODED
) -> tuple[DataFrame, list[str]]:
    """Feature vectors and labels of a city's listings (all cities if None), and the feature names."""
    rows = driver_features(select_listings(df, city=city))
    encoder = fit_encoder(rows, encoded, numbers)
    vectors = encoder.transform(rows).select("listing_id", "features", "label")
    return materialise(vectors, "driver-rows"), feature_names(encoder, encoded, numbers)


def _regression(names: list[str], penalty: float = 0.0, solver: str = "normal") -> LinearRegression:
    """The solver is the caller's choice; one that cannot take so many features is an error."""
    if solver == "normal" and len(names) > NORMAL_LIMIT:
        raise ValueError(f"{len(names)} features are too many for the normal equations: pass solver='l-bfgs'")
    return LinearRegression(
        solver=solver, regParam=penalty, elasticNetParam=0.0, standardization=True, tol=TOLERANCE, maxIter=STEPS
    )


def fit_drivers(
    df: DataFrame,
    city: str | None = None,
    alpha: float = 1e-4,
    numbers: list[str] = NUMBERS,
    encoded: list[str] = ENCODED,
    solver: str = "normal",
) -> DriverModel:
    """Ridge on standardised features; ``alpha`` 0 gives least squares (A-M10).

    MLlib penalises the standardised coefficients of raw, sparse features, so
    nothing is centred or filled in. Its penalty is relative to the rows and
    the deviation of the label, hence the factor.
    """
    rows, names = encoded_rows(df, city, numbers, encoded)
    metrics = Summarizer.metrics("mean", "std", "count").summary(F.col("features"))
    stats = rows.agg(metrics.alias("m"), F.stddev_pop("label").alias("spread")).select("m.*", "spread").first()
    n = stats["count"]
    penalty = alpha * stats["spread"] / n if alpha else 0.0
    model = _regression(names, penalty, solver).fit(rows)
    stds = stats["std"].toArray() * math.sqrt((n - 1) / n)
    return DriverModel(model, rows, names, stats["mean"].toArray(), stds, n)


def coefficients(fitted: DriverModel) -> DataFrame:
    """(feature, coef) per feature, in model order (A-M11)."""
    rows = [(i, name, float(c)) for i, (name, c) in enumerate(zip(fitted.names, fitted.coefficients))]
    return fitted.spark.createDataFrame(rows, "ord int, feature string, coef double")


def importance(fitted: DriverModel, top_n: int = 20) -> DataFrame:
    """Features by absolute coefficient."""
    sign = F.when(F.col("coef") > 0, F.lit("+")).otherwise(F.lit("-"))
    return (
        coefficients(fitted)
        .select("feature", F.col("coef").alias("coefficient"), F.abs("coef").alias("abs_coef"), sign.alias("direction"))
        .orderBy(F.desc("abs_coef"), "feature")
        .limit(top_n)
    )


def top_drivers(fitted: DriverModel, n: int = 10) -> DataFrame:
    """The n most positive and the n most negative features."""
    table = coefficients(fitted)

    def side(name: str, order) -> DataFrame:
        place = F.row_number().over(Window.orderBy(order, "feature"))
        return table.orderBy(order, "feature").limit(n).select(F.lit(name).alias("side"), place.alias("rank"), "feature", "coef")

    return side("positive", F.desc("coef")).unionByName(side("negative", F.asc("coef")))


def scatter(fitted: DriverModel) -> np.ndarray:
    """Sums of products of the centred features, p x p, added up on the executors."""
    width = len(fitted.names)
    means = fitted.means

    def part(batches):
        total = np.zeros((width, width))
        for batch in batches:
            centred = np.stack(batch["x"].to_numpy()) - means if len(batch) else np.zeros((0, width))
            total += centred.T @ centred
        yield pd.DataFrame({"i": range(width), "row": list(total)})

    sums = fitted.rows.select(vector_to_array("features").alias("x")).mapInPandas(part, "i int, row array<double>")
    cells = sums.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for i, j, v in cells.collect():
        out[i, j] = v
    return out


def rank(fitted: DriverModel) -> int:
    """How many features are linearly independent of the others and of the constant."""
    scale = np.where(fitted.stds > 0, fitted.stds, 1.0) * math.sqrt(fitted.n)
    return int(np.linalg.matrix_rank(scatter(fitted) / np.outer(scale, scale), tol=1e-9, hermitian=True))


def student_tail(t: float, df: float) -> float:
    """Chance that a t-distributed number lies further from 0 than ``t``: an incomplete beta function."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def terms():
        """Numerators of the fraction 1/(1 + t1/(1 + t2/(1 + ...)))."""
        for m in range(100_000):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            yield (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))

    # the value up to a term is a product of ratios of neighbouring numerators and denominators
    value, over, under = 1.0, 1.0, 0.0
    for n, term in enumerate(terms()):
        under = 1 / (1 + term * under) if n else 1 / (1 + term)
        over = 1 + term / over if n else 1.0
        value *= under * over
        if n and abs(under * over - 1) < 1e-15:
            break
    return front * value


def coefficient_table(fitted: DriverModel) -> DataFrame:
    """(feature, coef, std_error, t, p) of a least-squares fit on the standardised scale (A-M12).

    Collinear features share what they explain, as the pseudo-inverse divides it.
    The p-value is two-sided, from the t distribution.
    """
    errors = fitted.model.transform(fitted.rows)
    residual = F.col("label") - F.col("prediction")
    sse = errors.agg(F.sum(residual * residual)).first()[0]
    left = fitted.n - rank(fitted) - 1
    stds = np.where(fitted.stds > 0, fitted.stds, 1.0)
    inverse = np.linalg.pinv(scatter(fitted) / np.outer(stds, stds), rcond=1e-9, hermitian=True)
    spread = np.sqrt(np.clip(np.diag(inverse), 0, None) * sse / left)
    rows = []
    for name, coef, error in zip(fitted.names, fitted.coefficients, spread, strict=True):
        t = float(coef / error) if error > 0 else None
        rows.append((name, float(coef), float(error), t, None if t is None else student_tail(t, left)))
    return fitted.spark.createDataFrame(rows, "feature string, coef double, std_error double, t double, p double")


def fit_summary(fitted: DriverModel) -> DataFrame:
    """R², adjusted R², F, AIC, rows and degrees of freedom of a least-squares fit (A-M12)."""
    errors = fitted.model.transform(fitted.rows)
    residual = F.col("label") - F.col("prediction")
    sums = errors.agg(F.sum(residual * residual).alias("sse"), (F.var_pop("label") * F.count("label")).alias("sst")).first()
    n, k = fitted.n, rank(fitted)
    sse, sst = sums["sse"], sums["sst"]
    r2 = 1 - sse / sst
    left = n - k - 1
    row = (
        r2,
        1 - (1 - r2) * (n - 1) / left,
        ((sst - sse) / k) / (sse / left),
        n * (math.log(2 * math.pi) + math.log(sse / n) + 1) + 2 * (k + 1),
        n,
        k,
    )
    return fitted.spark.createDataFrame([row], "r2 double, adj_r2 double, fstat double, aic double, n_obs long, df_model int")


def driver_cv(df: DataFrame, city: str | None = None, folds: int = 10) -> DataFrame:
    """One row: mean and deviation of the held-out R² of least squares (A-M6)."""
    rows, names = encoded_rows(df, city)
    rows = rows.withColumn("fold", fold_of(folds=folds))
    measure = RegressionEvaluator(metricName="r2")
    scores = []
    for fold in range(folds):
        model = _regression(names).fit(rows.where(F.col("fold") != fold))
        scores.append(measure.evaluate(model.transform(rows.where(F.col("fold") == fold))))
    row = (float(np.mean(scores)), float(np.std(scores)), len(names), rows.count())
    return df.sparkSession.createDataFrame([row], "r2_mean double, r2_std double, n_features int, n_samples long")


def impact(fitted: DriverModel, feature: str, delta: float = 1.0) -> DataFrame:
    """Price change in percent when a feature grows by ``delta`` raw units (A-M13)."""
    if feature not in fitted.names:
        plain = [f for f in fitted.names if not f.startswith(("sector_", "agePossession_"))]
        raise ValueError(f"feature {feature!r} not found; there are {plain}")
    at = fitted.names.index(feature)
    std, coef = float(fitted.stds[at]), float(fitted.coefficients[at])
    # the reference scale of a constant feature is 1
    std = std or 1.0
    row = [(feature, float(delta), std, coef, coef * delta / std)]
    raw = fitted.spark.createDataFrame(row, "feature string, delta_raw double, std double, coef double, change double")
    return raw.select(
        "feature",
        "delta_raw",
        round_exact(F.col("std"), 4).alias("std_raw"),
        round_exact(F.col("coef"), 6).alias("coefficient"),
        round_exact(F.col("change"), 6).alias("log_change"),
        round_exact(F.expm1("change") * 100, 4).alias("price_pct"),
    )
