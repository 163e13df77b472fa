"""Phrases whose words occur together more often than their parts would.

The layout is that of external estimation of n-gram models: one stream of
counts, kept in two orders. Tasks count the n-grams of their texts by sorting
numbered words, and Spark adds the counts up. The streams of counts then lie in
prefix order (partitioned and sorted by the first words of a phrase) and in
suffix order (by its last words), and sort-merge joins walk them in lockstep:
the prefix order meets the counts of first parts and of right extensions, the
suffix order those of last parts and of left extensions. No table of counts is
hashed or broadcast, and a first word that starts much of a stream is split by
adaptive execution.

Counts are of all texts and whole texts. A phrase below the least count is not
kept past the sums, which loses nothing: parts and extensions that matter are at
least as frequent, or at least half as frequent and candidates themselves. For
the same reason three words are counted only where both their pairs may be
frequent: words and pairs are counted first, and a bitmap of fixed size with the
hashes of the frequent pairs goes to the tasks. A hash that strikes a wrong bit
costs a row and changes nothing.

Null text counts as empty, null language as ``und``. White space other than
blank, tab and the line breaks that end a piece belongs to words. Texts and
words of any length are read whole; repeated rows count again. Ties of score are
decided by the count, then by the phrase. Empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystead.llm.common import materialise

#: Bytes to what they are in a piece: small letters, line breaks between pieces, blanks between words.
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
SLICE = 8 << 20  # bytes of text counted at a time
ROWS = 250_000  # counts passed on at a time
BITS = 26  # binary logarithm of the number of bits in the map of frequent pairs: 8 MB
BLOCK = 12  # binary logarithm of the number of bytes in a block of that map
SALTS = (64, 8, 1)  # groups of a language that are ranked for themselves, step by step


# ---- counts inside a task


def slices(texts: list[bytes]) -> Iterator[bytes]:
    """Cleaned texts joined by line breaks, cut between pieces after about ``SLICE`` bytes."""
    held, size = [], 0
    for text in texts:
        text = text.translate(CLEAN)
        while len(text) > SLICE and (at := text.find(b"\n", SLICE)) >= 0:
            yield text[:at]
            text = text[at:]
        held.append(text)
        size += len(text)
        if size > SLICE:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def numbered(text: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of every word, number of its piece, and the words behind the numbers."""
    chars = np.frombuffer(text, np.uint8)
    is_word = (chars != 32) & (chars != 10)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(chars == 10), starts)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    data = chars[is_word]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, coded.dictionary


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.concatenate((first, [len(keys)])))


def pair_bits(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bits of pairs of hashed words."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F) + (second >> np.uint64(29)))
    return (mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS)


def hashed(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)


def frequent_pairs(pairs: DataFrame) -> np.ndarray:
    """The map of all phrases in ``pairs``, as bytes; a fixed size, whatever their number.

    Tasks mark their pairs in blocks of the map, and equal blocks are put over each other before they are collected.
    """
    names, kinds = ["block", "bits"], "block int, bits binary"

    def passed(blocks: list[int], bits: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(bits, pa.binary())], names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros((1 << BITS - 3 - BLOCK, 1 << BLOCK), np.uint8)
        flat, used = marks.reshape(-1), set()
        for batch in batches:
            both = hashed(pc.split_pattern(batch.column("phrase").cast(pa.binary()), b" ", max_splits=1).flatten())
            bits = pair_bits(both[::2], both[1::2])
            np.bitwise_or.at(flat, bits >> np.uint64(3), np.uint8(1) << (bits & np.uint64(7)).astype(np.uint8))
            used.update(np.unique(bits >> np.uint64(3 + BLOCK)).tolist())
        yield passed(sorted(used), [marks[k].tobytes() for k in sorted(used)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            for number, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                if number != block and held is not None:
                    yield passed([block], [held.tobytes()])
                own = np.frombuffer(bits, np.uint8)
                held, block = own | held if number == block else own, number
        if held is not None:
            yield passed([block], [held.tobytes()])

    marked = pairs.select("phrase").mapInArrow(mark, kinds).repartition("block").sortWithinPartitions("block")
    out = np.zeros((1 << BITS - 3 - BLOCK, 1 << BLOCK), np.uint8)
    for row in marked.mapInArrow(fold, kinds).collect():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def grams(
    ids: np.ndarray, piece: np.ndarray, size: int, width: int, likely: np.ndarray | None = None
) -> tuple[list[np.ndarray], np.ndarray]:
    """Words (as numbers) and count of every distinct n-gram inside a piece.

    width: how many numbers there are. likely: for every pair of neighbours, whether it may be frequent.
    """
    whole = piece[: len(piece) - size + 1] == piece[size - 1 :]
    if likely is not None:
        for k in range(size - 1):
            whole &= likely[k : k + len(whole)]
    keys, pairs = ids[: len(whole)], None
    for k in range(1, size):
        if k == 2 and width**3 >= 1 << 63:  # more words than fit three to a key: number the pairs
            pairs, keys = np.unique(keys, return_inverse=True)
        keys = keys * width + ids[k : k + len(whole)]
    keys, n = counted(keys[whole])
    parts = []
    for _ in range(size - 1):
        keys, last = np.divmod(keys, width)
        if pairs is not None:
            keys, pairs = pairs[keys], None
        parts.insert(0, last)
    return [keys, *parts], n


def phrase_counts(
    docs: DataFrame, sizes: tuple[int, ...], text: str = "text", lang: str = "lang", pairs: np.ndarray | None = None
) -> DataFrame:
    """lang, size, phrase, n for all n-grams of the given sizes; size 0 holds the number of words of a language.

    pairs: the map of frequent pairs; n-grams with another pair in them are left out.
    """
    shipped = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            by_lang: dict[str, list[bytes]] = {}
            for name, body in zip(batch.column("lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(name, []).append(body)
            for name, bodies in by_lang.items():
                for part in slices(bodies):
                    yield from of_slice(name, part)

    def of_slice(name: str, part: bytes) -> Iterator[pa.RecordBatch]:
        ids, piece, words = numbered(part)
        likely = None
        if shipped is not None:
            hashes = hashed(words)[ids]
            bits = pair_bits(hashes[:-1], hashes[1:])
            likely = (shipped.value[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1
        if 1 in sizes:
            yield passed(name, 0, pa.array([""]), np.array([len(ids)]))
        for size in sizes:
            if len(ids) < size:
                continue
            found, n = grams(ids, piece, size, max(len(words), 1), likely)
            for at in range(0, len(n), ROWS):
                texts = [words.take(pa.array(x[at : at + ROWS])) for x in found]
                phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary())) if size > 1 else texts[0]
                yield passed(name, size, phrase.cast(pa.binary()).cast(pa.string()), n[at : at + ROWS])

    def passed(name: str, size: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        fixed = [pa.repeat(pa.scalar(name, pa.string()), len(n)), pa.repeat(pa.scalar(size, pa.int32()), len(n))]
        return pa.RecordBatch.from_arrays([*fixed, phrase, pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.mapInArrow(count, "lang string, size int, phrase string, n long")
    # rows are sums of a slice already: adding them up once more before the shuffle would find little
    dealt = found.repartition("lang", "size", "phrase")
    return dealt.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


# ---- streams of counts


def merged(stream: DataFrame, counts: DataFrame, part: str, how: str = "inner") -> DataFrame:
    """Lockstep join of a stream with counts, both in the order of (lang, ``part``)."""
    return stream.hint("merge").join(counts.hint("merge"), ["lang", part], how)


def cuts(phrases: DataFrame) -> DataFrame:
    """Every way to cut a phrase in two: k, the first k words, the rest."""
    each = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    return each.select(
        "lang", "phrase", "a", "k",
        F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("rest"),
    )


def extensions(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longer: the largest count of a candidate with one more word on either side."""
    longer = phrases.where("size > 2").withColumns({
        "right": F.expr("substring_index(phrase, ' ', size - 1)"), "left": F.expr("substring_index(phrase, ' ', 1 - size)"),
    })
    inner = longer.select("lang", F.explode(F.array("right", "left")).alias("phrase"), "a")
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def first_of_each(scored: DataFrame, most: int) -> DataFrame:
    """The best ``most`` phrases of every language, with their rank.

    Groups of a language are ranked for themselves first, so one task never ranks a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in SALTS:
        group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(group).cast("long")).where(F.col("rank") <= most)
    return scored


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``most`` best phrases of two and three words in every language.

    least: occurrences of a candidate. A candidate is dropped if a longer one around it is at least half as frequent.
    """
    frequent = (F.col("n") >= least) | (F.col("size") == 0)
    short = materialise(phrase_counts(docs, (1, 2), text, lang).where(frequent), "phrase-counts")
    pairs = frequent_pairs(short.where("size = 2"))
    long = materialise(phrase_counts(docs, (3,), text, lang, pairs).where(frequent), "phrase-counts")
    known = short.unionByName(long)
    phrases = known.where("size >= 2").withColumnRenamed("n", "a")
    parts = known.where("size in (1, 2)")
    in_prefix_order = merged(cuts(phrases), parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), "first")
    in_suffix_order = merged(in_prefix_order, parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), "rest")
    lowest = F.min(F.struct(exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = in_suffix_order.groupBy("lang", "phrase", "a").agg(lowest)
    free = merged(scored, extensions(phrases), "phrase", "left").where("longer is null or 100 * longer < 50 * a")
    ranked = first_of_each(free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), most)
    words = materialise(known.where("size = 0").select("lang", "n"), "words")
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
