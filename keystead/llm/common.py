"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystead.storage import discard, materialise

__all__ = ["batched", "components", "discard", "free_name", "held_out", "materialise", "table", "texts"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def batched(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, longer where a column of docs has it."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Is crc32 of the id as text, modulo ``modulus``, equal to ``remainder``? A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): one row (node, root), root the smallest id reached.

    Every node keeps a pointer to a smaller node. A round hooks the roots of
    linked nodes to each other and then follows pointers twice, so the number of
    rounds grows with the logarithm of the longest chain. Links between nodes of
    one root are left out of the next round. Each round is a written table.
    No edges give no rows; links of a node to itself give a node alone.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    roots = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = materialise(roots.select("node", F.col("node").alias("root")), "roots")
    links = links.where("a <> b")
    while not links.isEmpty():
        # the larger root of a link points to the smallest root it is linked to
        hooks = links.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("low"))
        hooks = materialise(hooks, "hooks")
        while True:
            up = hooks.select(F.col("root").alias("low"), F.col("low").alias("lower"))
            further = materialise(hooks.join(up, "low", "left").select("root", "low", "lower"), "hooks")
            hooks = further.select("root", F.coalesce("lower", "low").alias("low"))
            if further.where("lower is not null").isEmpty():
                break
        roots = materialise(
            roots.join(hooks, "root", "left").select("node", F.coalesce("low", "root").alias("root")), "roots"
        )
        for end in ("a", "b"):
            move = hooks.select(F.col("root").alias(end), "low")
            links = links.join(move, end, "left").select(
                F.coalesce("low", end).alias(end), "b" if end == "a" else "a"
            )
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        links = materialise(links, "links")
    return roots


def runs(batches: Iterator, key: list[str]) -> Iterator:
    """Whole groups from pandas batches that are sorted by ``key``; a group may span batches."""
    import pandas as pd

    held: list = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        codes = batch.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
        starts = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1]), len(codes)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            part = batch.iloc[lo:hi]
            this = tuple(part.iloc[0][key])
            if held and this != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
            last = this
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
