"""Taking in new listings as they arrive."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystead.operators.recover import with_facts
from keystead.operators.rows import first_of_computed, first_per_key, is_empty_listing
from keystead.sources.keyed_sink import append_keyed, text_of
from keystead.storage import delete, materialise, names_in, touch


def landing_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """New files of a landing folder as a stream; a pattern such as ``orders.parque[t]`` takes a file or a folder."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def non_empty(batch: DataFrame) -> DataFrame:
    """Rows with any price, bedroom, area or parseable description (F2)."""
    area_text = F.col("rate") if "rate" in batch.columns else F.col("area")
    return with_facts(batch).where(~is_empty_listing(F.col("facts"), area_text)).drop("facts")


def save_batch(batch: DataFrame, sink: str, key: str = "property_id", order: str = "listing_id", name: str | None = None) -> None:
    """Append the first row of every key that the sink lacks (ST1, S5, W1).

    Running a batch again adds nothing: its keys are in the sink's index by then.
    """
    append_keyed(first_per_key(materialise(non_empty(batch), "batch"), [key], order), sink, key, name)


def ingest(stream: DataFrame, sink: str, checkpoint: str, key: str = "property_id", order: str = "listing_id") -> StreamingQuery:
    """Everything that has arrived since the last run, then stop (ST1).

    The keys seen so far live in the sink's index, not in the stream's state, so
    the state does not grow and the job resumes from its checkpoint. A batch that
    the stream repeats after a crash is known by its checkpoint and number.
    """
    stream_id = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: save_batch(batch, sink, key, order, f"{stream_id}-{number:010d}"))
        .start()
    )


def unique_within(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key, remembered for ``delay`` (ST2)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


DAY_MS = 86_400_000


def first_or_late(stream: DataFrame, path: str, checkpoint: str, key: str, time: str, delay_ms: int) -> StreamingQuery:
    """The first row of each key to ``path/rows``, and the rows that come too late to ``path/late`` (ST2).

    A row is late if its time lies more than the delay before the latest time of the batches before. Spark drops such
    rows; here they are an output. Of the others the first of a key passes, by time and then by the row itself. The
    keys of the rows that passed are the state: a table by batch and day, of which a batch reads the days from twice
    the delay before the latest time on; older ones may be deleted. A batch that is marked as done is not taken
    again; one that a crash left without its mark is removed and written anew.
    """
    spark = stream.sparkSession
    stream_id = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def take(batch: DataFrame, number: int) -> None:
        done = dict(name.rsplit("-", 1) for name in names_in(spark, f"{path}/done"))  # batch to its latest time
        name = f"{stream_id}.{number:010d}"
        if name in done:
            return
        for part in ("rows", "late", "seen"):
            delete(spark, f"{path}/{part}/batch={name}")
        mark = max(map(int, done.values()), default=-(1 << 60)) - delay_ms
        columns = batch.columns
        rows = materialise(batch.withColumns({"time in ms": F.coalesce(F.unix_millis(time), F.lit(0)), "key as text": text_of(key)}), "batch")
        late = F.col("time in ms") < mark
        order = F.struct("time in ms", F.to_json(F.struct(*columns)))
        first = first_of_computed(rows.where(~late).withColumn("order of row", order), ["key as text"], "order of row")
        recent = [f"{path}/seen/batch={b}" for b, latest in done.items() if int(latest) >= mark - delay_ms]
        if recent:
            seen = spark.read.schema("known string, day long").option("basePath", f"{path}/seen").parquet(*recent)
            seen = seen.where(F.col("day") >= (mark - delay_ms) // DAY_MS).select("known").distinct()
            first = first.join(seen, F.col("key as text") == F.col("known"), "left_anti")
        first = materialise(first, "first")
        first.select(*columns).write.parquet(f"{path}/rows/batch={name}")
        rows.where(late).select(*columns).write.parquet(f"{path}/late/batch={name}")
        day = F.floor(F.col("time in ms") / DAY_MS).alias("day")
        first.select(F.col("key as text").alias("known"), day).repartition("day").write.partitionBy("day").parquet(f"{path}/seen/batch={name}")
        latest = rows.agg(F.max("time in ms")).first()[0]
        touch(spark, f"{path}/done/{name}-{latest if latest is not None else 0}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()


def read_told_apart(spark: SparkSession, path: str, part: str = "rows") -> DataFrame:
    """The rows of all marked batches: ``rows`` or ``late`` ones."""
    names = [name.rsplit("-", 1)[0] for name in names_in(spark, f"{path}/done")]
    return spark.read.parquet(*[f"{path}/{part}/batch={name}" for name in names])


def append_stream(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write an append stream to a table until it has caught up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
