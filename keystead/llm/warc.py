"""WARC archives: writing and reading records, and resolving revisits.

An archive is a folder of gzipped files of WARC/1.1 records, written and read
by Spark's own text source: records are told apart by their version line, so a
row is one record and no file is held whole. A payload that holds the version
line itself makes its record come out short; files with such a record, and
only those, are read again byte by byte.

``deduplicate`` shuffles headers only (digest, ids, url) by payload digest: the
first record of a digest is the original, the others revisit it. What it found
goes back to the records by their unique record id, so a digest that holds a
third of all records is never one group of payloads; its headers are counted
before the shuffle and joined in a sort-merge join whose hot key adaptive
execution splits. Payloads are shuffled only where the table of revisits is too
large to be broadcast.

Records are rows (record_id, page_id, url, date, record_type, payload,
payload_digest, refers_to_record, refers_to, refers_to_url, refers_to_date,
intact). A null url is written as none, a null payload as an empty one; blanks,
line breaks and tabs in a url are written as percent codes, as they would end
its header line. A null page_id is written without its field and comes after
all others when the original is chosen; of records with equal ids one is the
original. Repeated rows are records of their own. Payloads of any length
and any bytes come back as they were; rows in, records out: none is dropped. An
empty table gives archives without records. Other columns are not archived.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystead.llm.common import materialise
from keystead.storage import new_path

VERSION = "WARC/1.1\r\n"
#: Profile of a revisit whose payload equals that of an earlier record (fixed value of WARC/1.1).
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, page_id long, url string, date string, record_type string, payload binary, payload_digest string, "
    "refers_to_record string, refers_to long, refers_to_url string, refers_to_date string, intact boolean"
)
NAMES = [field.split()[0] for field in RECORD.split(", ")]
#: Field of the header, column, and how a value stands in the line.
FIELDS = [
    ("WARC-Record-ID", "record_id", "<%s>"),
    ("WARC-Date", "date", "%s"),
    ("WARC-Target-URI", "url", "%s"),
    ("WARC-Payload-Digest", "payload_digest", "sha256:%s"),
    ("WARC-Refers-To", "refers_to_record", "<%s>"),
    ("WARC-Refers-To-Target-URI", "refers_to_url", "%s"),
    ("WARC-Refers-To-Date", "refers_to_date", "%s"),
    ("Page-ID", "page_id", "%s"),
    ("Refers-To-Page-ID", "refers_to", "%s"),
]
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def safe_url(url: Column) -> Column:
    """A url that fits on one header line."""
    for char in "\r\n\t ":
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return url


def fresh_id(number: Column, salt: str) -> Column:
    """A record id from a number that is unique in its archive."""
    digest = F.md5(F.concat(F.lit(salt), number.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def responses(rows: DataFrame, page_id: str, url: str, text: str, date: str | None = None) -> DataFrame:
    """A response record for every row; the payload is the text in UTF-8."""
    date = date or now()
    payload = F.coalesce(F.col(text), F.lit("")).cast("binary")
    none = F.lit(None).cast("string")
    return rows.select(
        fresh_id(F.monotonically_increasing_id(), date).alias("record_id"),
        F.col(page_id).cast("long").alias("page_id"),
        safe_url(F.col(url)).alias("url"),
        F.lit(date).alias("date"),
        F.lit("response").alias("record_type"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"),
        none.alias("refers_to_record"),
        none.cast("long").alias("refers_to"),
        none.alias("refers_to_url"),
        none.alias("refers_to_date"),
        F.lit(True).alias("intact"),
    )


def _line(name: str, column: str, form: str) -> Column:
    """A header line, empty where the value is null."""
    before, after = form.split("%s")
    return F.coalesce(F.concat(F.lit(f"{name}: {before}"), F.col(column).cast("string"), F.lit(f"{after}\r\n")), F.lit(""))


def write_archives(records: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Records as gzipped WARC files in the folder ``path``, at most ``per_file`` to a file.

    The block of a response is an HTTP head and the payload; that of a revisit is the head alone.
    """
    payload = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    head = F.concat(F.lit(f"{HTTP}Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    length = (F.octet_length(head) + F.octet_length(payload)).cast("string")
    profile = F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {SAME_PAYLOAD}\r\n")).otherwise(F.lit(""))
    text = F.concat(
        F.lit(f"{VERSION}WARC-Type: "), F.col("record_type"), F.lit("\r\n"),
        *[_line(*field) for field in FIELDS], profile,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length, F.lit("\r\n\r\n"),
        head, payload.cast("string"),
    )
    writer = records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).option("zlib.compress.level", "BEST_SPEED").text(path)


def _value(head: Column, name: str, form: str) -> Column:
    """The value of a header field, null if it is absent."""
    before, after = form.split("%s")
    pattern = rf"(?im)^{name}:[ \t]*{before}([^\r\n]*?){after}[ \t]*\r?$"
    return F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 1))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path``.

    ``intact`` says whether the payload of a response has the digest of its header.
    A record that the end of its file cuts off is left out.
    """
    pieces = spark.read.option("lineSep", VERSION).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    pieces = pieces.where(F.length("value") > 0)
    head = F.concat(F.substring_index("value", "\r\n\r\n", 1), F.lit("\r\n"))
    cut = pieces.select(
        "file", head.alias("head"),
        F.substring(F.col("value").cast("binary"), F.octet_length(head) + 3, F.octet_length("value")).alias("rest"),
    ).withColumn("size", F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("int"))
    # a whole record is its block and two line breaks; what differs holds the version line, or is the rest of one that does
    whole = F.coalesce(F.octet_length("rest") == F.col("size") + 4, F.lit(False))
    split = [row.file for row in cut.where(~whole).select("file").distinct().collect()]
    found = parsed(cut)
    if split:
        odd = spark.createDataFrame([(x,) for x in split], "file string")
        found = parsed(cut.join(F.broadcast(odd), "file", "left_anti"))
        blobs = spark.read.format("binaryFile").load(split).select("content").repartition(len(split))
        raw = blobs.mapInArrow(_records, "head string, rest binary, size int")
        found = found.unionByName(parsed(raw))
    return found


def parsed(cut: DataFrame) -> DataFrame:
    """Records from (head, rest, size): header lines, bytes from the block on, length of the block."""
    block = F.substring(F.col("rest"), F.lit(1), F.col("size"))
    http = F.when(F.col("head").rlike(r"(?im)^Content-Type:[ \t]*application/http"), F.octet_length(F.substring_index(block.cast("string"), "\r\n\r\n", 1)) + 4)
    payload = F.substring(block, F.coalesce(http, F.lit(0)) + 1, F.col("size"))
    typed = cut.select(
        F.regexp_extract("head", r"(?im)^WARC-Type:[ \t]*(\S+)", 1).alias("record_type"),
        *[_value(F.col("head"), name, form).alias(column) for name, column, form in FIELDS],
        payload.alias("payload"),
    ).withColumns({c: F.col(c).try_cast("long") for c in ("page_id", "refers_to")})
    same = (F.col("record_type") == "revisit") | (F.sha2("payload", 256) == F.col("payload_digest"))
    return typed.withColumn("intact", F.coalesce(same, F.lit(False))).select(*NAMES)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of whole gzipped files, each found by the length of the one before."""
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            at, version = 0, VERSION.encode()
            while (at := data.find(version, at)) >= 0:
                end = data.find(b"\r\n\r\n", at)
                length = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", data[at : max(end, at)])
                if end < 0 or not length or end + 4 + int(length[1]) > len(data):
                    break
                size = int(length[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([data[at + len(version) : end + 2].decode("utf-8", "replace")]), pa.array([data[end + 4 : end + 4 + size]], pa.binary()), pa.array([size], pa.int32())],
                    ["head", "rest", "size"],
                )
                at = end + 4 + size


def revisits(records: DataFrame, least: int = 100) -> DataFrame:
    """record_id of every record that repeats an earlier payload of at least ``least`` bytes, and what it refers to.

    The smallest page_id is the original. Only headers are shuffled.
    """
    large = F.octet_length("payload") >= least
    headers = records.where("record_type = 'response'").where(large)
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url", "date")
    headers = materialise(headers.select(F.unhex("payload_digest").alias("digest"), place.alias("place")), "headers")
    originals = headers.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = headers.join(materialise(originals.drop("n"), "originals"), "digest")
    return found.where("place.record_id <> first.record_id").select(
        F.col("place.record_id").alias("record_id"),
        F.col("first.record_id").alias("to_record"), F.col("first.page_id").alias("to_page"),
        F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"),
    )


def deduplicate(records: DataFrame, date: str | None = None, least: int = 100) -> DataFrame:
    """The records with fresh headers, repeated payloads as revisits of their first response.

    Records that are revisits already keep what they refer to.
    """
    known = materialise(revisits(records, least), "revisits")
    joined = records.join(known, "record_id", "left")
    again = F.col("to_record").isNotNull()
    return joined.withColumns({
        "record_type": F.when(again, "revisit").otherwise(F.col("record_type")),
        "payload": F.when(~again, F.col("payload")).otherwise(F.lit(b"")),
        "refers_to_record": F.coalesce("to_record", "refers_to_record"),
        "refers_to": F.coalesce("to_page", "refers_to"),
        "refers_to_url": F.coalesce("to_url", "refers_to_url"),
        "refers_to_date": F.coalesce("to_date", "refers_to_date"),
        "date": F.lit(date or now()),
    }).select(*NAMES)


def headers_of(records: DataFrame) -> DataFrame:
    """What an archive says of every page: its full payload's length and digest, its type, the page it refers to.

    The digest of a response is taken from its bytes; a revisit is joined to the response it names for the length.
    """
    facts = records.select(
        "record_id", "page_id", "record_type", "refers_to_record", "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )
    facts = materialise(facts, "record-headers")
    plain = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    again = facts.where("record_type = 'revisit'").drop("record_id", "payload_bytes")
    named = again.select(F.col("refers_to_record").alias("record_id")).distinct()
    sizes = facts.where("record_type <> 'revisit'").join(named, "record_id", "left_semi").select("record_id", "payload_bytes")
    sizes = materialise(sizes.withColumnRenamed("record_id", "refers_to_record"), "originals")
    return facts.where("record_type <> 'revisit'").select(*plain).unionByName(again.join(sizes, "refers_to_record", "left").select(*plain))


def archive(rows: DataFrame, path: str, page_id: str = "page_id", url: str = "url", text: str = "html", least: int = 100) -> DataFrame:
    """Archives of ``rows`` without repeated payloads in the folder ``path``; returns their records, read back.

    The rows are first written as they come, one response each, as a crawl leaves them.
    """
    spark = rows.sparkSession
    crawl = new_path(spark, "crawl")
    write_archives(responses(rows, page_id, url, text), crawl)
    write_archives(deduplicate(read_archives(spark, crawl), least=least), path)
    return read_archives(spark, path)
