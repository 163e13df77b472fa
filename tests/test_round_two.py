"""Cases that once gave wrong answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystead.operators import furnish, pages, rows
from keystead.plans import drivers
from keystead.sources import dims, tables
from keystead.sources.order_pages import order_pages

FOLDER = "/root/testdata/sf0.001"
FULL, BARE = "['3 Fan', '2 Bed', '1 Sofa']", None


def levels(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "listing_id long, furnishDetails string")
    got = furnish.furnishing_levels(df, **more).collect()
    assert len(got) == len(texts)
    return [r["furnishing_type"] for r in sorted(got, key=lambda r: r["listing_id"])]


def test_few_furnishing_texts(spark):
    assert levels(spark, [FULL, FULL]) == [0, 0]
    assert levels(spark, [FULL, FULL, BARE, "", "[]"], starts=3) == [1, 1, 0, 0, 0]
    assert levels(spark, [None, "", None]) == [0, 0, 0]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("property_id,price,area\nP1,1 Cr,\"9,000\"\n")
    row = tables.read_raw_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row["property_id"], row["price"], row["area"], row["link"]) == ("P1", "1 Cr", "9,000", "")


def test_other_cities_stay_and_null_ids_come_once(spark, tmp_path):
    path = str(tmp_path / "by")
    df = spark.createDataFrame(
        [("g", "flat", "1"), ("b", "flat", "1"), ("b", "flat", None)], "city string, property_type string, property_id string"
    )
    tables.write_by_city_and_kind(df.where("city = 'g'"), path)
    tables.write_by_city_and_kind(df.where("city = 'b'"), path)
    tables.append_by_city_and_kind(df, path)
    assert spark.read.parquet(path).count() == 3
    plain = str(tmp_path / "plain")
    for _ in range(3):
        tables.append_new(df.where("property_id is null"), plain)
    assert spark.read.parquet(plain).count() == 1


def test_repeated_detail_pages_give_one_listing(spark):
    found = pages.listings_from_pages(order_pages(spark, FOLDER), "flats", "site.example")
    assert found.count() == found.select("link").distinct().count() > 100


def test_rank_and_errors_equal_numpy_on_collinear_features(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    random = np.random.default_rng(0)
    a, b = random.normal(size=300), random.normal(size=300)
    x = np.stack([a, b, a + b, np.full(300, 2.0), 3 * a], axis=1)
    y = 1 + a - 2 * b + random.normal(size=300)
    df = spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ["features", "label"])
    model = LinearRegression(regParam=0.0, solver="normal").fit(df)
    fitted = drivers.DriverModel(model, df, list("abcde"), x.mean(axis=0), x.std(axis=0), 300)
    summary = drivers.fit_summary(fitted).first()
    design = np.column_stack([np.ones(300), a, b])
    rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    sse, sst = rest @ rest, ((y - y.mean()) ** 2).sum()
    assert summary["df_model"] == 2
    assert summary["adj_r2"] == pytest.approx(1 - sse / sst * 299 / 297)
    assert summary["fstat"] == pytest.approx((sst - sse) / 2 / (sse / 297))
    plain = drivers.DriverModel(LinearRegression(regParam=0.0).fit(df2 := two(spark, a, b, y)), df2, ["a", "b"], np.array([a.mean(), b.mean()]), np.array([a.std(), b.std()]), 300)
    errors = [r["std_error"] for r in drivers.coefficient_table(plain).collect()]
    want = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse / 297)[1:] * [a.std(), b.std()]
    assert errors == pytest.approx(list(want), rel=1e-6)


def two(spark, a, b, y):
    from pyspark.ml.linalg import Vectors

    return spark.createDataFrame([(Vectors.dense(float(p), float(q)), float(v)) for p, q, v in zip(a, b, y)], ["features", "label"])


def test_wide_models_need_a_chosen_solver():
    names = [f"f{i}" for i in range(drivers.NORMAL_LIMIT + 1)]
    with pytest.raises(ValueError, match="l-bfgs"):
        drivers._regression(names)
    assert drivers._regression(names, solver="l-bfgs").getSolver() == "l-bfgs"


def test_a_constant_feature_has_scale_one(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(Vectors.dense(2.0, float(k)), float(k)) for k in range(9)], ["features", "label"])
    fitted = drivers.DriverModel(LinearRegression().fit(df), df, ["same", "k"], np.array([2.0, 4.0]), np.array([0.0, 2.58]), 9)
    assert drivers.impact(fitted, "same", 5.0).first()["std_raw"] == 1.0


def test_group_sizes_keep_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted((r["k"] or "", r["group_size"]) for r in rows.with_group_size(df, "k").collect()) == [("", 1), ("a", 2), ("a", 2)]


def test_streams_take_folders_of_part_files(spark, tmp_path):

    import __spark_entry__ as contract

    for name in ("orders", "customer", "nation", "events"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    queries = contract.queries()
    for name in ("ingest_new", "stream_dedup"):
        want = {tuple(r) for r in queries[name](spark, FOLDER).select(sorted(queries[name](spark, FOLDER).columns)).collect()}
        df = queries[name](spark, str(tmp_path))
        assert {tuple(r) for r in df.select(sorted(df.columns)).collect()} == want


def test_fixed_tables_hold_what_they_should():
    assert dims.AMENITY_WEIGHTS and all(isinstance(w, int) for w in dims.AMENITY_WEIGHTS.values())
    assert len(dims.SECTOR_ALIASES) > 5


def test_discarded_tables_are_gone(spark):
    from pathlib import Path

    from keystead.storage import discard, materialise

    table = materialise(spark.range(3), "gone")
    place = table.written_to.removeprefix("file://").removeprefix("file:")
    assert Path(place).exists() and table.where(F.col("id") > 0).count() == 2
    discard(table)
    assert not Path(place).exists()
