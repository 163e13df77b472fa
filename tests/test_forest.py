"""Trees grown in tasks: node by node, in few jobs, for any dealing of rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from test_models import listings  # noqa: F401

from keystead.plans import bins, boosting, forest, price


def jobs(spark, run):
    """What a call returns, and the jobs it took."""
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    return run(), count() - before


def table(n, seed=0):
    """Two numbers, a pair of flags that any row may have both of, and a category of six levels as codes without the first."""
    draw = np.random.default_rng(seed)
    level = draw.integers(0, 6, n)
    codes = np.zeros((n, 6))
    codes[np.arange(n), level] = 1
    x = np.column_stack([np.round(draw.normal(size=n), 2), draw.integers(1, 5, n), draw.integers(0, 2, (n, 2)), codes[:, 1:]]).astype(float)
    return x, np.round(x[:, 0] + 0.3 * level + draw.normal(0, 0.1, n), 3)


def vectors(spark, x, y, ids=None):
    ids = range(len(y)) if ids is None else ids
    schema = StructType([StructField("listing_id", LongType()), StructField("label", DoubleType()), StructField("features", VectorUDT())])
    return spark.createDataFrame([(i, float(b), Vectors.dense(a)) for i, a, b in zip(ids, x, y, strict=True)], schema)


GROUPS = [range(4, 9)]


def by_hand(codes, y, w, depth, chosen, sizes):
    """Scores of one tree; codes: the bin of every feature, chosen: by level and place of a node the features it may use."""
    out = np.zeros(len(y))
    nodes = [np.flatnonzero(w > 0)]
    everywhere = [np.arange(len(y))]
    for level in range(depth + 1):
        features = chosen(len(nodes))
        inner = []
        for k, (on, rows) in enumerate(zip(nodes, everywhere, strict=True)):
            weight, value = w[on], y[on]
            out[rows] = (weight * value).sum() / weight.sum()
            cost = lambda s: (weight[s] * value[s]).sum() ** 2 / weight[s].sum()  # noqa: E731, B023
            best = (1e-9, None)
            for f in features[k] if level < depth else ():
                for b in range(sizes[f] - 1):
                    right = codes[on, f] > b
                    if right.any() and not right.all():
                        gain = cost(right) + cost(~right) - cost(np.ones(len(on), bool))
                        if gain > best[0] + 1e-9:
                            best = gain, (f, b)
            if best[1]:
                f, b = best[1]
                for side in (codes[:, f] <= b, codes[:, f] > b):
                    inner.append((on[side[on]], rows[side[rows]]))
        if not inner:
            break
        nodes, everywhere = [a for a, _ in inner], [b for _, b in inner]
    return out


@pytest.mark.parametrize("large", [0, 40, 10**9])
def test_tree_equals_one_grown_node_by_node(monkeypatch, large):
    monkeypatch.setattr(forest, "LARGE_NODE", large)
    monkeypatch.setattr(forest, "LOOKUP_CELLS", 30)
    x, y = table(300)
    cuts = [np.quantile(x[:, 0], [0.25, 0.5, 0.75]), np.array([1.5, 2.5, 3.5]), *[np.array([0.5])] * 7]
    how = bins.layout(cuts, GROUPS)
    assert len(how.sizes) == 5 and sorted(how.sizes) == [2, 2, 4, 4, 6]
    own = how.coded(x)
    codes = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1)
    for seed in range(5):
        w = np.random.default_rng(seed).integers(0, 3, 300)
        tree = forest.Grower(how, 6, own).grow(y, w, np.random.default_rng(seed))
        draw = np.random.default_rng(seed)
        want = by_hand(codes, y, w.astype(float), 6, lambda n, draw=draw: forest.subsets(draw, n, 9, 3), [len(c) + 1 for c in cuts])
        for few in (0, 30, 10**9):
            monkeypatch.setattr(forest, "FEW_ROWS", few)
            assert np.allclose(tree.scores(np.ascontiguousarray(own.T)), want, atol=1e-9) and len(tree.value) > 20


def test_drawn_features_are_different_and_even():
    got = forest.subsets(np.random.default_rng(1), 6000, 7, 3)
    assert (np.diff(got, axis=1) > 0).all() and got.min() == 0 and got.max() == 6
    assert np.allclose(np.bincount(got.ravel()) / 6000, 3 / 7, atol=0.03)


def test_cuts_lie_between_few_values_and_at_quantiles_of_many(spark):
    x = np.column_stack([np.arange(1000.0), np.repeat([0.0, 0.0, 0.0, 5.0], 250), np.ones(1000), np.append(np.zeros(999), 1.0)])
    cuts = bins.cut_points(vectors(spark, x, x[:, 0]).repartition(5), 8)
    assert np.allclose(cuts[0], [125 * k for k in range(1, 8)], atol=3)
    assert [c.tolist() for c in cuts[1:]] == [[2.5], [], [0.5]]


def test_forest_is_as_good_as_that_of_mllib(spark):
    x, y = table(900, 5)
    df = vectors(spark, x, y)
    train, test = df.where("listing_id < 600"), df.where("listing_id >= 600").drop("label")
    estimator = price.forest(60, 12)
    own = forest.fit(train, forest.forest_of(estimator), GROUPS).transform(test)
    theirs = estimator.fit(train).transform(test)
    error = [np.mean((np.array([r.prediction for r in one.orderBy("listing_id").collect()]) - y[600:]) ** 2) for one in (own, theirs)]
    assert error[0] < 0.5 * y.var() and error[0] == pytest.approx(error[1], rel=0.15)


def test_dealing_repeated_and_missing_ids(spark):
    x, y = table(200, 2)
    how = forest.Forest(trees=8, depth=5, seed=3)
    score = lambda df: {tuple(r.features.toArray()): r.prediction for r in forest.fit(df, how, GROUPS).transform(df).collect()}
    df = vectors(spark, x, y)
    one, other = score(df.repartition(1)), score(df.repartition(5))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)
    ids = [None if k % 9 == 0 else 7 for k in range(200)]
    repeated = forest.fit(vectors(spark, x, y, ids), how, GROUPS).transform(vectors(spark, x, y, ids)).collect()
    errors = [(r.prediction - r.label) ** 2 for r in repeated]
    assert len(repeated) == 200 and np.mean(errors) < 0.5 * y.var()  # not drawn all together or not at all
    with pytest.raises(Exception, match="label is missing"):
        forest.fit(df.withColumn("label", F.when(F.col("listing_id") != 5, F.col("label"))), how)


def test_what_trees_in_tasks_lack_is_left_to_mllib(spark):
    assert forest.forest_of(price.forest()) == forest.Forest()
    assert forest.forest_of(RandomForestRegressor(featureSubsetStrategy="all")) is None
    assert forest.forest_of(price.forest().setMinInstancesPerNode(3)) is None


def test_rows_too_many_for_a_task(spark, listings, monkeypatch):  # noqa: F811
    """Boosted trees get the same scores by histograms that tasks add up; forests are MLlib's."""
    rows = price.encoded(listings[0], 3)
    models = {"forest": price.forest(4, 4), "boosted": price.boosted(8)}
    near = price.fold_outcomes(rows, models, 3)
    monkeypatch.setattr(bins, "LOCAL_BYTES", 0)
    far = price.fold_outcomes(rows, models, 3)
    assert np.allclose(near["boosted"], far["boosted"], rtol=1e-6)
    assert [len(x) for x in far["forest"]] == [3] * 4 and far["forest"] != near["forest"]
    assert boosting.layout([np.array([0.5])]).fits(0) and not boosting.layout([np.array([0.5])]).fits(1)
    model, _ = price.fit_final(listings[0], models["forest"])
    assert not isinstance(model.stages[-1], forest.ForestModel)


def test_jobs_do_not_grow_with_trees_and_depth(spark, listings):  # noqa: F811
    df = listings[0]
    compare = lambda *sizes: price.compare(df, {"forest": price.forest(*sizes), "boosted": price.boosted(sizes[0])}, folds=3)
    (_, few), (_, many) = (jobs(spark, lambda s=s: compare(*s)) for s in ((2, 2), (25, 15)))
    assert abs(many - few) <= 6
    (_, few), (_, many) = (jobs(spark, lambda s=s: price.fit_final(df, price.forest(*s))) for s in ((2, 2), (25, 15)))
    assert abs(many - few) <= 6
