"""A growing table whose rows have a key, with an index of the keys beside it (S5, S6, ST1).

``path/rows/batch=…`` holds the rows of every batch, ``path/keys/bucket=…``
their keys by hash, ``path/done/…`` one empty file for every batch that is
whole. To find out what is new, a batch reads the buckets that its keys fall
into, and of those the keys only: rows are never read, and the other buckets
are pruned as partitions.

Rows are written first, then keys, then the mark. A crash in between leaves a
batch without a mark: if its rows are whole its keys are written again, which
does no harm, as the index is a set; else its rows are removed. A batch that is
marked is not taken twice, so a stream may repeat its last one. One writer at a
time; readers see marked batches only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystead.storage import delete, exists, materialise, names_in, read_if_present, touch

BUCKETS = 64


def text_of(key: str) -> Column:
    """A key as text that differs from every other, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _keyed(df: DataFrame, key: str) -> DataFrame:
    text = text_of(key)
    return df.select(text.alias("known"), F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _write_keys(rows: DataFrame, path: str, key: str) -> None:
    _keyed(rows, key).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/keys")


def stored_keys_for(new: DataFrame, path: str, key: str) -> DataFrame | None:
    """``known``, ``bucket`` of the stored keys in the buckets that the keys of ``new`` fall into."""
    hit = [row.bucket for row in _keyed(new, key).select("bucket").distinct().collect()]  # at most BUCKETS numbers
    index = read_if_present(new.sparkSession, f"{path}/keys", schema="known string, bucket int")
    return None if index is None else index.where(F.col("bucket").isin(hit))


def repair(spark: SparkSession, path: str, key: str) -> list[str]:
    """Finish or remove the batches that a crash left without a mark; returns their names."""
    done = set(names_in(spark, f"{path}/done"))
    open_ = [b.removeprefix("batch=") for b in names_in(spark, f"{path}/rows") if b.startswith("batch=")]
    open_ = [b for b in open_ if b not in done]
    for batch in open_:
        folder = f"{path}/rows/batch={batch}"
        if exists(spark, f"{folder}/_SUCCESS"):
            _write_keys(spark.read.parquet(folder), path, key)
            touch(spark, f"{path}/done/{batch}")
        else:
            delete(spark, folder)
    return open_


def append_keyed(new: DataFrame, path: str, key: str = "property_id", batch: str | None = None) -> None:
    """Append the rows whose key, null included, the table lacks; keys in ``new`` are unique.

    batch: its name, for a source that may bring the same batch again.
    """
    spark = new.sparkSession
    batch = batch or uuid.uuid4().hex
    repair(spark, path, key)
    if exists(spark, f"{path}/done/{batch}"):
        return
    new = materialise(new, "batch")
    known = stored_keys_for(new, path, key)
    fresh = new if known is None else new.join(known.select("known"), text_of(key) == F.col("known"), "left_anti")
    folder = f"{path}/rows/batch={batch}"
    fresh.write.parquet(folder)
    _write_keys(spark.read.schema(fresh.schema).parquet(folder), path, key)
    touch(spark, f"{path}/done/{batch}")


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all whole batches, or None if there are none."""
    folders = [f"{path}/rows/batch={batch}" for batch in names_in(spark, f"{path}/done")]
    return spark.read.option("mergeSchema", True).parquet(*folders) if folders else None
