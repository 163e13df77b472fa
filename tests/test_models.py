"""Similarity by brute force; linear models by their closed form; trees by quality."""

import numpy as np
import pandas as pd
import pytest

from keystead.operators import furnish, similar
from keystead.plans import drivers, price
from keystead.schemas import FINAL


@pytest.fixture(scope="module")
def listings(spark):
    rng = np.random.default_rng(3)
    n = 400
    city = rng.choice(["gurgaon", "bangalore"], n)
    sector = [f"sector {i}" if c == "gurgaon" else f"place {i}, bangalore" for i, c in zip(rng.integers(1, 6, n), city)]
    beds, area = rng.integers(1, 6, n), rng.integers(400, 4000, n).astype(float)
    value = np.round(0.2 + area / 1500 * (1 + 0.1 * beds) * np.where(city == "gurgaon", 1.3, 1.0) * np.exp(rng.normal(0, 0.1, n)), 2)
    pdf = pd.DataFrame({
        "listing_id": np.arange(n), "city": city, "property_type": rng.choice(["flat", "house"], n), "sector": sector, "price": value,
        "bedRoom": beds, "bathroom": rng.integers(1, 4, n), "balcony": rng.choice(["0", "1", "3+"], n),
        "agePossession": rng.choice(["New Property", "Relatively New", "Old Property", "Under Construction"], n), "built_up_area": area,
        "servant room": rng.integers(0, 2, n), "store room": rng.integers(0, 2, n), "furnishing_type": rng.integers(0, 3, n),
        "luxury_category": rng.choice(["Low", "Medium", "High"], n), "floor_category": rng.choice(["Low Floor", "Mid Floor"], n),
    })
    for c in ("bedRoom", "bathroom", "servant room", "store room", "furnishing_type"):
        pdf[c] = pdf[c].astype("int32")
    return spark.createDataFrame(pdf, FINAL).cache(), pdf


def scores(pdf, anchor, weights):
    x = pdf[similar.NUMERIC].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    row = pdf.iloc[anchor]
    cat = (pdf[similar.CATEGORICAL] == row[similar.CATEGORICAL]).sum(axis=1) / len(similar.CATEGORICAL)
    loc = (pdf[similar.LOCATION] == row[similar.LOCATION]).sum(axis=1) / 2
    return weights[0] * z @ z[anchor] + weights[1] * cat.to_numpy() + weights[2] * loc.to_numpy()


def best(pdf, anchor, n, weights=similar.WEIGHTS, same_city=False):
    score = scores(pdf, anchor, weights)
    order = sorted((i for i in range(len(pdf)) if i != anchor and (not same_city or pdf.city[i] == pdf.city[anchor])), key=lambda i: (-score[i], i))
    return order[:n], [round(float(score[i]), 4) for i in order[:n]]


def test_recommend(listings):
    df, pdf = listings
    for anchor, same, weights in ((5, False, similar.WEIGHTS), (77, True, (1.0, 0.0, 0.0))):
        rows = similar.recommend(df, anchor, 7, same, weights).orderBy("Rank").collect()
        ids, want = best(pdf, anchor, 7, weights, same)
        assert [r["listing_id"] for r in rows] == ids
        assert np.allclose([r["SimilarityScore"] for r in rows], want, atol=1e-4)
    with pytest.raises(ValueError):
        similar.recommend(df, 10**6)


def test_recommend_by_filters(listings):
    df, pdf = listings
    chosen = pdf[(pdf.city == "gurgaon") & (pdf.bedRoom == 3)]
    anchor = min(chosen.index, key=lambda i: (abs(pdf.price[i] - chosen.price.median()), i))
    got = similar.recommend_by_filters(df, city="gurgaon", bedrooms=3, top_n=4).orderBy("Rank").collect()
    assert [r["listing_id"] for r in got] == best(pdf, anchor, 4, same_city=True)[0]
    none = similar.recommend_by_filters(df, sector="atlantis")
    assert none.count() == 0 and "SimilarityScore" in none.columns


def test_similar_to_each(spark, listings, monkeypatch):
    df, pdf = listings
    monkeypatch.setattr(similar, "ANCHOR_BLOCK", 3)
    anchors = spark.createDataFrame([(i,) for i in (0, 9, 31, 200, 399)], "anchor_id long")
    got = {}
    for r in similar.similar_to_each(df.repartition(6), anchors, 5).orderBy("anchor_id", "Rank").collect():
        got.setdefault(r["anchor_id"], []).append(r["listing_id"])
    assert got == {i: best(pdf, i, 5)[0] for i in (0, 9, 31, 200, 399)}


def test_copies_of_one_listing_tie_by_id(spark, listings):
    df, _ = listings
    copies = df.where("listing_id = 8").crossJoin(spark.range(1000, 1300).withColumnRenamed("id", "new")).selectExpr("new AS listing_id", *[f"`{c}`" for c in df.columns[1:]])
    got = similar.similar_to_each(df.unionByName(copies), spark.createDataFrame([(8,)], "anchor_id long"), 5).orderBy("Rank").collect()
    assert [r["listing_id"] for r in got] == [1000, 1001, 1002, 1003, 1004]


def design(pdf):
    x = pd.DataFrame({
        "property_type": (pdf.property_type == "house").astype(float), "bedRoom": pdf.bedRoom, "bathroom": pdf.bathroom, "built_up_area": pdf.built_up_area,
        "servant room": pdf["servant room"], "furnishing_type": pdf.furnishing_type, "luxury_category": pdf.luxury_category.map({"Low": 0, "Medium": 1, "High": 2}),
    }).astype(float)
    age = pdf.agePossession.map({"Relatively New": "new", "New Property": "new", "Old Property": "old", "Under Construction": "under construction"})
    return pd.concat([x, pd.get_dummies(pdf.sector, prefix="sector", drop_first=True, dtype=float), pd.get_dummies(age, prefix="agePossession", drop_first=True, dtype=float)], axis=1)


def test_ridge_is_closed_form(listings):
    df, pdf = listings
    part = pdf[pdf.city == "gurgaon"]
    x = design(part)
    z = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    y = np.log1p(part.price.to_numpy())
    for alpha in (1e-4, 50.0):
        fitted = drivers.fit_drivers(df, "gurgaon", alpha)
        got = {r["feature"]: r["coef"] for r in drivers.coefficients(fitted).collect()}
        want = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
        assert set(got) == set(x.columns)
        assert np.allclose([got[c] for c in x.columns], want, atol=1e-6)


def test_summary_and_impact(listings):
    df, pdf = listings
    part = pdf[pdf.city == "gurgaon"]
    x, y = design(part), np.log1p(part.price.to_numpy())
    a = np.column_stack([np.ones(len(x)), x])
    sse = float(np.sum((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2))
    sst, n, k = float(np.sum((y - y.mean()) ** 2)), len(y), x.shape[1]
    fitted = drivers.fit_drivers(df, "gurgaon", 0.0)
    row = drivers.fit_summary(fitted).first()
    want = (1 - sse / sst, 1 - sse / sst * (n - 1) / (n - k - 1), (sst - sse) / k / (sse / (n - k - 1)), n * np.log(2 * np.pi * sse / n) + n + 2 * (k + 1))
    assert np.allclose([row["r2"], row["adj_r2"], row["fstat"], row["aic"]], want, rtol=1e-6)
    assert (row["n_obs"], row["df_model"]) == (n, k)
    effect = drivers.impact(fitted, "built_up_area", 100.0).first()
    raw = np.linalg.lstsq(a, y, rcond=None)[0][1 + list(x.columns).index("built_up_area")]
    assert abs(effect["price_pct"] - np.expm1(100 * raw) * 100) < 1e-3
    with pytest.raises(ValueError):
        drivers.impact(fitted, "moon")
    top = drivers.top_drivers(fitted, 3).collect()
    assert len(top) == 6 and top[0]["coef"] >= top[1]["coef"]


def test_price_models_beat_the_mean(spark, listings, tmp_path):
    df, _ = listings
    table = price.compare(df, {"forest": price.forest(10, 8), "boosted": price.boosted(20)}, folds=3).collect()
    assert len(table) == 2 and sum(r["winner"] for r in table) == 1
    assert all(r["r2_mean"] > 0.5 for r in table)
    path = str(tmp_path / "model")
    model = price.load_or_fit(spark, path, df, price.forest(10, 8))
    again = price.load_or_fit(spark, path, df, price.forest(1, 1))
    request = spark.createDataFrame(
        [("flat", "sector 2", 3, 2, "1", "Relatively New", 1500.0), ("flat", "sector unknown", 3, 2, "9", "Relatively New", 1500.0)],
        "property_type string, sector string, bedRoom int, bathroom int, balcony string, agePossession string, built_up_area double",
    )
    first, second = (price.predict(m, request).select("predicted_price", "likely", "rate").collect() for m in (model, again))
    assert first == second and price.expects_city(again)
    assert all(0 < r["predicted_price"] < 100 and r["likely"]["low"] < r["likely"]["high"] for r in first)


def test_unknown_level_is_the_base_level(spark):
    from keystead.plans.encode import feature_names, fit_encoder

    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, x double")
    encoder = fit_encoder(df, ["k"], ["x"])
    assert feature_names(encoder, ["k"], ["x"]) == ["x", "k_c", "k_b"]
    rows = encoder.transform(spark.createDataFrame([("a", 0.0), ("zzz", 0.0), ("b", 0.0), ("c", 0.0)], "k string, x double"))
    assert [list(r["features"].toArray()) for r in rows.collect()] == [[0, 0, 0], [0, 0, 0], [0, 0, 1], [0, 1, 0]]


def test_furnishing_levels_are_ordered(spark):
    texts = ["['2 Fan', '1 Bed', '4 AC', '3 Sofa']"] * 20 + ["['1 Fan', '1 Bed']"] * 20 + ["['No Fan', 'No Bed']"] * 20 + [None] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "listing_id int, furnishDetails string")
    level = {r["listing_id"]: r["furnishing_type"] for r in furnish.furnishing_levels(df).collect()}
    assert (level[0], level[20], level[40], level[64]) == (2, 1, 0, 0) and len(level) == 65


def test_furnish_counts(spark):
    df = spark.createDataFrame([(1, "['2 Fan', 'Exhaust Fan']"), (2, "['No Exhaust Fan', '3 Bed']"), (3, None)], "listing_id int, furnishDetails string")
    assert sorted(map(tuple, furnish.furnish_counts(df).collect())) == [(1, "Exhaust Fan", 1), (1, "Fan", 2), (2, "Bed", 3), (2, "Fan", 1)]


def test_registered_price_models_have_the_published_sizes(spark, monkeypatch):
    from oracle import registry

    fitted = {}
    monkeypatch.setattr(registry, "final", lambda spark, folder: None)
    monkeypatch.setattr(registry.price, "fit_final", lambda table, model: fitted.update(predict=model) or (None, None))
    monkeypatch.setattr(registry.price, "predict", lambda model, table: table_stub)
    monkeypatch.setattr(registry.price, "compare", lambda table, models, folds=10: fitted.update(models, folds=folds))
    table_stub = type("Table", (), {"select": lambda self, *columns: None})()
    registry.price_predict(None, "")
    registry.price_compare(None, "")
    for name in ("predict", "forest"):
        assert (fitted[name].getNumTrees(), fitted[name].getMaxDepth()) == (500, 30)
    assert (fitted["boosted"].getMaxIter(), fitted["folds"]) == (500, 10)
