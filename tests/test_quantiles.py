"""Exact quantiles against NumPy, also where one group or value dominates."""

import numpy as np
import pytest

from keystead.operators.quantiles import medians, quantiles


def table(spark, seed):
    rng = np.random.default_rng(seed)
    hot = [("a", float(v)) for v in np.where(rng.random(3000) < 0.4, 7.25, rng.normal(0, 50, 3000))]
    wide = [("b", float(v)) for v in 10.0 ** rng.uniform(-6, 9, 501)]
    dense = [("c", 1e6 + i * 1e-7) for i in range(1000)]
    few = [("d", 1.0), ("d", 4.0), ("e", -0.0), ("f", None), (None, 3.0)]
    return hot + wide + dense + few


@pytest.mark.parametrize("partitions", [1, 13])
def test_against_numpy(spark, partitions):
    rows = table(spark, partitions)
    df = spark.createDataFrame(rows, "k string, v double").repartition(partitions)
    wanted = {"q1": ("v", 0.25), "m": ("v", 0.5), "q9": ("v", 0.9)}
    got = {r["k"]: (r["q1"], r["m"], r["q9"]) for r in quantiles(df, ["k"], wanted).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    for key, found in got.items():
        values = [v for k, v in rows if k == key]
        assert np.allclose(found, np.quantile(values, [0.25, 0.5, 0.9]), rtol=1e-12)


def test_whole_table_and_several_columns(spark):
    df = spark.range(1, 1002).selectExpr("cast(id as double) v", "cast(id % 10 as int) w")
    assert tuple(medians(df, [], {"v": "v", "w": "w"}).first()) == (501.0, float(np.median([i % 10 for i in range(1, 1002)])))
    empty = medians(df.where("v < 0"), [], {"v": "v"}).collect()
    assert [tuple(r) for r in empty] == [(None,)]
