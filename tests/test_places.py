"""Aliases of places: names that hold none of them skip the fold, all others go through it in order."""

from pyspark.sql import functions as F

from keystead.functions.place import any_of, apply_aliases
from keystead.sources.dims import SECTOR_ALIASES, SECTOR_CLEANUPS

ODD = [("", "z"), ("a.b", "(c)"), ("(c)", "d"), ("\n", "q"), ("[", "#"), ("é", "e")]


def folded(name, pairs):
    for old, new in pairs:
        name = name.replace(old, new) if name is not None and old else name
    return name


def test_aliases_equal_the_fold(apply):
    texts = [None, "", "sector 9", "a.b", "axb", "xa.bé[", "one\ntwo", "]", *[f"{old} x" for old, _ in SECTOR_ALIASES]]
    for pairs in (None, ODD):
        known = SECTOR_ALIASES + SECTOR_CLEANUPS if pairs is None else pairs
        assert apply(lambda c, pairs=pairs: apply_aliases(c, pairs), texts) == [folded(t, known) for t in texts]


def test_places_without_an_alias_skip_the_fold(spark):
    df = spark.createDataFrame([("sector 9",)], "x string").select(apply_aliases(F.col("x")).alias("y"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" in plan.upper().split("AGGREGATE(")[0]
    assert any_of(["ab", "ac", "b."]) == r"a(?:b|c)|b(?:\.)"
