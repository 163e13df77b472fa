"""Stream and batch give the same; nothing is taken twice."""

from pyspark.sql import functions as F

from keystead.operators.rows import first_per_key
from keystead.sources import tables
from keystead.sources.keyed_sink import read_keyed
from keystead.sources.order_listings import raw_listings
from keystead.streaming import ingest

FOLDER = "/root/testdata/sf0.001"


def test_two_runs_and_a_repeat(spark, tmp_path):
    raw = raw_listings(spark, FOLDER)
    landing, sink, checkpoint = (str(tmp_path / d) for d in ("landing", "sink", "checkpoint"))
    third = F.col("listing_id") % 3
    for part in (0, 1):
        raw.where(third == part).write.mode("append").parquet(landing)
        ingest.ingest(ingest.landing_stream(spark, landing, raw.schema), sink, checkpoint).awaitTermination()
    # The rest arrives together with copies of what is stored.
    raw.where(third != 0).write.mode("append").parquet(landing)
    ingest.ingest(ingest.landing_stream(spark, landing, raw.schema), sink, checkpoint).awaitTermination()
    stored = read_keyed(spark, sink)
    batch = first_per_key(ingest.non_empty(raw), ["property_id"])
    assert stored.count() == stored.select("property_id").distinct().count() == batch.count()
    ingest.save_batch(raw, sink)
    assert read_keyed(spark, sink).count() == batch.count()


def test_unique_within_is_distinct(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    landing = str(tmp_path / "landing")
    events.union(events).write.parquet(landing)
    stream = ingest.unique_within(ingest.landing_stream(spark, landing, events.schema), "event_id", "ts", "60 days")
    ingest.append_stream(stream, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "sink"))
    assert stored.count() == events.count()


def test_raw_csv_sources(spark, tmp_path):
    from keystead.schemas import raw_schema

    names = raw_schema("flat").names
    row = {**{c: "" for c in names}, "property_id": "P1", "description": 'two\nlines, "quoted"', "area": "9,000"}
    spark.createDataFrame([tuple(row[c] for c in names)], raw_schema("flat")).write.option("header", True).option("escape", '"').csv(str(tmp_path / "flats"))
    house = spark.createDataFrame([tuple("7" if c == "rate" else "" for c in raw_schema("house").names)], raw_schema("house"))
    house.write.option("header", True).csv(str(tmp_path / "houses"))
    sources = [(str(tmp_path / "flats"), "flat", "gurgaon"), (str(tmp_path / "houses"), "house", "gurgaon"), (str(tmp_path / "none"), "flat", "bangalore")]
    got = {r["property_type"]: r for r in tables.read_sources(spark, sources).collect()}
    assert got["flat"]["description"] == row["description"] and got["flat"]["rate"] == "9,000"
    assert got["house"]["rate"] == "7" and got["house"]["city"] == "gurgaon"
    try:
        tables.read_sources(spark, sources[2:])
        raise AssertionError("a missing source set must fail")
    except FileNotFoundError:
        pass


def test_partitioned_sink(spark, tmp_path):
    raw = raw_listings(spark, FOLDER)
    path = str(tmp_path / "by_city")
    tables.write_by_city_and_kind(raw, path)
    back = spark.read.parquet(path)
    assert back.count() == raw.count()
    assert tables.stored_keys(spark, path).count() == raw.select("property_id").distinct().count()
    assert tables.stored_keys(spark, str(tmp_path / "nothing")) is None
    ids = tables.with_listing_id(raw.drop("listing_id"))
    assert ids.select("listing_id").distinct().count() == raw.count()
