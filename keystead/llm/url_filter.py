"""Operator 4, URL rules by a blocked Bloom filter and an exact hash join.

A rule is a host and the start of a path; it fits the host, its subdomains and
every path with that start. A URL's possible keys are all ends of its host,
joined with the starts of its path of the lengths that rules have. A blocked Bloom
filter of the rules' keys, of a fixed size whatever the number of rules, drops
nearly all keys that no rule has. URLs without a possible key have their verdict at
once and are never shuffled; the others meet the rules in an exact join,
which removes false positives. The longest fitting rule decides.

Defined cases: a null URL or one without ``://`` has an empty host and path,
which no rule fits; very long URLs are read whole; rules without host or path are left out, of equal rules the
alphabetically first verdict counts; repeated rows give repeated results; columns other
than page_id and url are not read; empty tables of pages or rules are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import batched, materialise

#: Odd multipliers of the split-block Bloom filter in the public Parquet format (fixed values).
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def possible_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every end of the host at a dot, with every start of the path of the given lengths."""
    labels = F.split(host, r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    starts = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: path.substr(F.lit(1), n)
    )
    pairs = F.flatten(F.transform(ends, lambda end: F.transform(starts, lambda start: F.concat(end, start))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(pairs)


def bloom_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """blocks x 8 words of 32 bits from a column ``hash``; combined on the executors, at most ``blocks`` rows back."""
    low = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))

    def product(salt: int) -> Column:
        """low * salt modulo 2**32, in halves that do not overflow."""
        upper = (low * (salt >> 16)).bitwiseAND(F.lit(0xFFFF))
        return (low * (salt & 0xFFFF) + F.shiftleft(upper, 16)).bitwiseAND(F.lit(0xFFFFFFFF))

    one = F.lit(1).cast("long")
    bits = [F.bit_or(F.call_function("shiftleft", one, F.shiftrightunsigned(product(salt), 27).cast("int"))) for salt in SALTS]
    block = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(blocks)).alias("block")
    out = np.zeros((blocks, 8), np.uint32)
    for row in keys.groupBy(block).agg(*bits).collect():
        out[row[0]] = row[1:]
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hashes = hashes.view(np.uint64)
    block = (hashes >> np.uint64(32)) % np.uint64(len(words))
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    held = np.ones(len(hashes), bool)
    for k, salt in enumerate(SALTS):
        bit = (low * np.uint32(salt)) >> np.uint32(27)
        held &= (words[block, k] >> bit) & np.uint32(1) == 1
    return held


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", blocks: int = 1 << 13) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page.

    rules: host, path, verdict. default: the verdict of a URL on no list.
    blocks: 32 bytes each; about 20 rules a block keep false positives rare, and
    more rules only send more keys to the exact join.
    """
    listed = rules.where("host <> '' and path <> ''").groupBy("host", "path").agg(F.min("verdict").alias("listed"))
    listed = listed.select(F.concat("host", "path").alias("key"), F.length("host").alias("host_size"), "listed")
    # a text can be cut into host and path in only one way: paths begin with a slash
    lengths = sorted(r[0] for r in rules.where("path <> ''").select(F.length("path")).distinct().collect())
    words = bloom_filter(listed.select(F.xxhash64("key").alias("hash")), blocks)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "host", "path", "possible"]
        for batch in batches:
            hashes, keys = batch.column("hashes"), batch.column("keys").to_pylist()
            flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            held = may_hold(words, flat).tolist()
            at, possible = 0, []
            for own in keys:
                possible.append([key for key, yes in zip(own, held[at : at + len(own)], strict=True) if yes])
                at += len(own)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield batched(names, kinds, [batch.column(name) for name in names[:3]] + [possible])

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = urls.withColumn("keys", possible_keys(F.col("host"), F.col("path"), lengths))
    keyed = keyed.withColumn("hashes", F.transform("keys", lambda key: F.xxhash64(key)))
    row = ["page_id", "host", "path"]
    # written, as its two parts go different ways and are screened once
    screened = materialise(keyed.mapInArrow(screen, "page_id long, host string, path string, possible array<string>"), "screened")
    clear = screened.where(F.size("possible") == 0).select(*row, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # equal rows travel as one row with their number
    counted = screened.where(F.size("possible") > 0).groupBy(*row, "possible").agg(F.count(F.lit(1)).alias("copies"))
    pairs = counted.select(*row, "copies", F.explode("possible").alias("key")).join(listed, "key", "left")
    fits = F.when(F.col("listed").isNotNull(), F.struct(F.length("key"), "host_size", "key", "listed"))
    judged = pairs.groupBy(*row).agg(F.max(fits).alias("best"), F.max("copies").alias("copies"))
    judged = judged.select(
        *row,
        F.col("best.key").alias("rule"),
        F.coalesce("best.listed", F.lit(default)).alias("verdict"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    )
    return clear.unionByName(judged.drop("copy"))
