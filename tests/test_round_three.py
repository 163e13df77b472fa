"""Random places, first rows, furnishing pieces, anchors in chunks, keyed sinks, late rows, stored models, parallel folds."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from keystead.functions import features as ft
from keystead.operators import furnish, rows, similar
from keystead.plans import boosting, drivers, encode, price, store
from keystead.sources import keyed_sink
from keystead.storage import delete, exists, names_in, touch
from tests.test_models import best, listings  # noqa: F401


def drawn(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16)


def test_random_places_equal_a_sort(spark):
    df = spark.range(5000).select(F.col("id").alias("listing_id"), F.lit("x").alias("band"), F.lit(1).alias("held"))
    df = df.withColumnsRenamed({"band": "kind", "held": "n"})
    order = sorted(range(5000), key=lambda k: (drawn(42, k), k))
    got = rows.random_places(df.repartition(13)).orderBy("place").collect()
    assert [r.listing_id for r in got] == order and [r.place for r in got] == list(range(1, 5001))
    for n in (1, 37, 5000, 9000):
        assert {r.listing_id for r in rows.seeded_sample(df, n).collect()} == set(order[:n])
    assert rows.seeded_sample(df.limit(0), 5).collect() == [] and rows.shuffled(df.limit(0)).collect() == []
    folds = {r.listing_id: (r.f, r.h) for r in df.select("listing_id", rows.fold_of().alias("f"), rows.is_held_out().alias("h")).collect()}
    assert all(folds[k] == (drawn(42, k) % 10, drawn(43, k) % 1000 < 200) for k in range(5000))


def test_first_rows_of_null_and_hot_keys(spark):
    data = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else f"k{i % 50}", i % 2) for i in range(600)]
    df = spark.createDataFrame(data, "listing_id long, k string, part int")
    want = {}
    for i, k, part in data:
        want.setdefault((k, part), i)
    for kept in (rows.first_per_key(df, ["k", "part"]), rows.first_of_computed(df, ["k", "part"], "listing_id")):
        assert kept.columns == df.columns
        assert sorted(r.listing_id for r in kept.collect()) == sorted(want.values())
    assert rows.first_per_key(df.limit(0), ["k"]).collect() == []


def test_items_in_pieces_equal_items_in_texts(spark):
    """Against every text held against every item."""
    texts = [
        "['2 Fan', 'Exhaust Fan', 'No Fan']", "['3 Bed', '1 Bedside Lamp']", "[No Sofa, 12 Fan, 4 Fan]", "['Water''s edge', 'A']", "[]", "", None,
        "['99999999999 Fan']", "['Modular Kitchen With Island', '2 Modular Kitchen']", "['0 Bed']", "['é Lamp', '٣ Fan', '5 é']", "Fan",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "listing_id long, furnishDetails string")
    items = [r.item for r in furnish.vocabulary(df).collect()]
    assert len(items) > 8
    pairs = spark.createDataFrame([(i, t, item) for i, t in enumerate(texts) if t is not None for item in items], "i long, t string, item string")
    counted = pairs.select("i", "item", ft.item_count(F.col("t"), F.col("item")).alias("n")).where("n > 0")
    assert sorted(map(tuple, furnish.furnish_counts(df).collect())) == sorted(map(tuple, counted.collect()))


def test_scaled_counts_and_vectors(spark):
    texts = ["['2 Fan', '1 Bed']", "['2 Fan', '1 Bed']", "['4 Fan', '1 Bed']", None, "['1 Bed']"]
    df = spark.createDataFrame(list(enumerate(texts)), "listing_id long, furnishDetails string")
    fans, beds = np.array([2, 2, 4, 0, 0]), np.array([1, 1, 1, 0, 1])
    got = {(r.text, r.item): (r.weight, r.value) for r in furnish.scaled_counts(furnish.distinct_texts(df)).collect()}
    assert got[texts[0], "Fan"] == pytest.approx((2, 2 / fans.std())) and got[texts[4], "Bed"] == pytest.approx((1, 1 / beds.std()))
    vectors = {r.text: (r.weight, r.features.toArray().tolist()) for r in furnish.count_vectors(furnish.distinct_texts(df)).collect()}
    assert vectors[""] == (1, [0, 0]) and vectors[texts[2]] == (1, pytest.approx([1 / beds.std(), 4 / fans.std()]))
    assert furnish.count_vectors(furnish.distinct_texts(df.where("furnishDetails is null"))) is None


def test_clusters_have_the_least_cost(spark):
    """Of eight texts, against all ways to part them into three."""
    texts = ["['1 Fan']", "['2 Fan']", "['2 Fan', '1 Bed']", "['9 Fan', '3 Bed']", "['8 Fan', '3 Bed']", "['4 Sofa', '9 Fan']", "['5 Sofa', '9 Fan']", None]
    df = spark.createDataFrame(list(enumerate(texts)), "listing_id long, furnishDetails string")
    points = {r.text: r.features.toArray() for r in furnish.count_vectors(furnish.distinct_texts(df)).collect()}
    x = np.array([points[t or ""] for t in texts])

    def cost(labels):
        return sum(((x[labels == k] - x[labels == k].mean(0)) ** 2).sum() for k in set(labels.tolist()))

    least = min(cost(np.array([n // 3**i % 3 for i in range(8)])) for n in range(3**8))
    got = np.array([r.furnishing_type for r in furnish.furnishing_levels(df).orderBy("listing_id").collect()])
    assert cost(got) == pytest.approx(least) and got[7] == 0


def test_furnishing_bands(apply):
    texts = [None, "", "[]", "['2 Fan', 'No Bed']", "['a', 'b', 'c']", "[a, b, c, d, e, f]"]
    assert apply(furnish.furnishing_band, texts) == [0, 0, 0, 0, 1, 2]


@pytest.mark.parametrize(("chunk", "block"), [(20_000, 256), (37, 3)])
def test_anchors_in_chunks(listings, monkeypatch, chunk, block):  # noqa: F811
    df, pdf = listings
    monkeypatch.setattr(similar, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(similar, "ANCHOR_BLOCK", block)
    spark = df.sparkSession
    anchors = [0, 5, 77, 78, 79, 200, 399]
    got = similar.similar_to_each(df, spark.createDataFrame([(a,) for a in [*anchors, 5]], "anchor_id long"), 6).collect()
    assert len(got) == 6 * len(anchors)
    for a in anchors:
        found = sorted((r for r in got if r.anchor_id == a), key=lambda r: r.Rank)
        ids, want = best(pdf, a, 6)
        assert [r.listing_id for r in found] == ids and np.allclose([r.SimilarityScore for r in found], want, atol=1e-4)
    assert similar.similar_to_each(df, spark.createDataFrame([], "anchor_id long")).collect() == []


def test_folds_side_by_side_equal_one_by_one(listings):  # noqa: F811
    df = listings[0].where("listing_id < 150")
    models = {"tree": DecisionTreeRegressor(maxDepth=4, seed=1), "boosted": GBTRegressor(maxIter=12, maxDepth=3, seed=1, featureSubsetStrategy="0.8")}
    table = {r.model: r for r in price.compare(df, models, 4).collect()}
    encoded = price.encoded(df, 4)
    assert encoded.count() == 150
    r2 = []
    for fold in range(4):
        fitted = models["tree"].fit(encoded.where(F.col("fold") != fold))
        scored = fitted.transform(encoded.where(F.col("fold") == fold)).select("label", "prediction").toPandas()
        r2.append(1 - ((scored.label - scored.prediction) ** 2).sum() / ((scored.label - scored.label.mean()) ** 2).sum())
    assert table["tree"].r2_mean == pytest.approx(np.mean(r2)) and table["tree"].r2_std == pytest.approx(np.std(r2))
    assert sum(r.winner for r in table.values()) == 1


def grown(codes, rest, weight, depth, penalty, allowed, bins):
    """Scores of one tree, grown node by node."""
    out = np.zeros(len(codes))

    def grow(rows_, level):
        on = rows_[weight[rows_] > 0]
        g, n = rest[on].sum(), len(on)
        best_ = (1e-9, None)
        for f in np.flatnonzero(allowed) if level < depth else ():
            for b in range(bins[f] - 1):
                left = codes[on, f] <= b
                if 0 < left.sum() < n:
                    parts = [(rest[on][side].sum(), side.sum()) for side in (left, ~left)]
                    gain = sum(x * x / (m + penalty) for x, m in parts) - g * g / (n + penalty)
                    if gain > best_[0] + 1e-12:
                        best_ = gain, (f, b)
        if best_[1] is None:
            out[rows_] = g / (n + penalty)
        else:
            f, b = best_[1]
            grow(rows_[codes[rows_, f] <= b], level + 1)
            grow(rows_[codes[rows_, f] > b], level + 1)

    grow(np.arange(len(codes)), 0)
    return out


def test_boosting_equals_trees_grown_node_by_node(spark):
    from pyspark.ml.linalg import Vectors

    draw = np.random.default_rng(4)
    x = np.round(np.column_stack([draw.normal(size=120), draw.integers(0, 2, 120), draw.normal(size=120), np.ones(120)]), 3)
    y = x[:, 0] * 2 + x[:, 1] + draw.normal(0, 0.1, 120)
    df = spark.createDataFrame([(i, float(y[i]), Vectors.dense(x[i])) for i in range(120)], ["listing_id", "label", "features"])
    how = boosting.Boosting(trees=13, depth=3, rate=0.3, rows=0.7, columns=0.5, seed=9, bins=8)
    fits = [F.col("listing_id") % 3 != 0, F.col("listing_id") % 3 != 1]
    cuts = boosting.cut_points(df, how.bins)
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    want = np.zeros((120, 2))
    for k in range(2):
        trains = np.arange(120) % 3 != k
        score = np.full(120, y[trains].mean())
        for tree in range(how.trees):
            allowed = np.zeros(4, bool)
            allowed[np.random.default_rng((9, k, tree)).permutation(4)[:2]] = True
            weight = (trains & (boosting.drawn(np.arange(120), 9, k, tree) < how.rows)).astype(float)
            score = score + how.rate * grown(codes, y - score, weight, how.depth, how.penalty, allowed, [len(c) + 1 for c in cuts])
        want[:, k] = score
    for parts in (1, 3):
        state, trees = boosting.boosted_scores(df.repartition(parts), fits, how)
        got = {int(i): s for one in state.collect() for i, s in zip(one.ids, one.score, strict=True)}
        assert np.allclose([got[i] for i in range(120)], want, atol=1e-9) and len(trees) == 13


def test_one_hot_rows_equal_the_vectors(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "a", None), (3, None, 3), (4, "c", 10)], "listing_id long, k string, n int")
    levels = encode.level_table(df.where("listing_id < 4"), ["k", "n"])
    assert sorted((r.column, r.level, r.position, r.feature) for r in levels.collect()) == [
        ("k", "a", 0, None), ("k", "b", 1, "k_b"), ("n", "2", 0, None), ("n", "3", 1, "n_3"),
    ]
    assert sorted(map(tuple, encode.one_hot(df, levels, ["k", "n"]).collect())) == [(1, "k_b", 1.0), (3, "n_3", 1.0)]


def test_t_distribution():
    """Known quantiles, and the finite sum for even degrees."""
    assert drivers.student_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert drivers.student_tail(12.70620474, 1) == pytest.approx(0.05, abs=1e-9)
    for df in (2, 4, 30, 1000):
        for t in (0.1, 1.0, 3.0):
            cos2, sin = df / (df + t * t), t / math.sqrt(df + t * t)
            term = total = 1.0
            for j in range(1, df // 2):
                term *= (2 * j - 1) / (2 * j) * cos2
                total += term
            assert drivers.student_tail(t, df) == pytest.approx(1 - sin * total, abs=1e-10)


def test_stored_versions(spark, tmp_path, listings):  # noqa: F811
    path = str(tmp_path / "model")
    fit = lambda: price.fit(price.training_frame(listings[0]), DecisionTreeRegressor(maxDepth=3))
    assert store.load(spark, path) is None
    store.load_or_fit(spark, path, fit)
    folder = store.save(spark, fit(), path)
    assert len(store.versions(spark, path)) == 2
    delete(spark, f"{folder}/{store.WHOLE}")
    assert len(store.versions(spark, path)) == 1 and store.load(spark, path) is not None
    newest = store.save(spark, fit(), path)
    assert newest.rsplit("/", 1)[1][:11] == "v0000000003"
    store.keep_newest(spark, path, 1)
    assert store.versions(spark, path) == [newest.rsplit("/", 1)[1]]


KEYS = "id long, k string"


def test_keyed_sink_after_crashes(spark, tmp_path):
    path = str(tmp_path / "sink")
    df = lambda *rows_: spark.createDataFrame(list(rows_), KEYS)
    stored = lambda: sorted(((r.id, r.k) for r in keyed_sink.read_keyed(spark, path).collect()), key=repr)
    assert keyed_sink.read_keyed(spark, path) is None
    keyed_sink.append_keyed(df((1, "a"), (2, None), (3, "")), path, "k", "one")
    keyed_sink.append_keyed(df((9, "z")), path, "k", "one")  # the same batch again
    assert stored() == [(1, "a"), (2, None), (3, "")]
    # rows written, neither keys nor mark
    df((4, "b"), (5, "c")).write.parquet(f"{path}/rows/batch=two")
    # torn: rows without the mark of the writer
    df((6, "d")).write.parquet(f"{path}/rows/batch=three")
    delete(spark, f"{path}/rows/batch=three/_SUCCESS")
    assert stored() == [(1, "a"), (2, None), (3, "")]
    keyed_sink.append_keyed(df((7, "b"), (8, None), (9, "d"), (10, "=a")), path, "k", "four")
    assert stored() == [(1, "a"), (10, "=a"), (2, None), (3, ""), (4, "b"), (5, "c"), (9, "d")]
    assert sorted(names_in(spark, f"{path}/done")) == ["four", "one", "two"] and not exists(spark, f"{path}/rows/batch=three")
    touch(spark, f"{path}/done/.tmp")


def test_keyed_sink_reads_only_the_buckets_it_needs(spark, tmp_path):
    path = str(tmp_path / "sink")
    keyed_sink.append_keyed(spark.range(2000).select(F.col("id"), F.col("id").cast("string").alias("k")), path, "k")
    known = keyed_sink.stored_keys_for(spark.createDataFrame([(1, "7"), (2, "1999")], KEYS), path, "k")
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert known.select("bucket").distinct().count() <= 2 and 2 <= known.count() < 300
