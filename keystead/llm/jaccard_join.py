"""Operator 8, similarity join on word n-grams by a MinHash LSH forest.

A document is the set of its n-word shingles. Documents with equal sets are one
class member with a weight. Each of ``trees`` MinHash trees gives a set a label of
eight levels, one byte a level, so that sorting labels is walking a prefix trie.
Matched prefixes start at full depth and are shortened level by level until
pairs at the threshold are found with the target probability. Sets under
one prefix are linked to the first of them as candidates; connected candidates form a
neighbourhood. Inside a neighbourhood every pair is verified exactly, in blocks
of bounded size, whichever prefix brought it there; only counts and block labels
leave a block, never pairs. Verified links again give connected classes.

Defined cases: words are runs without white space, in lower case; texts of
fewer than n words have one shingle of all words; null, empty and blank
texts have none and are linked to nothing; rows without an id are left out;
rows that repeat id and text count once, and an id with several texts is judged
by one of them; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import batched, components, free_name, materialise, runs, texts

LEVELS = 8


def shared_depth(trees: int, threshold: float, target: float) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with the target probability."""
    depth = LEVELS
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; word hashes are remembered up to a bound."""

    def __init__(self, words: int, kept: int = 400_000):
        self.words, self.kept = words, kept
        self.known: dict[str, int] = {}

    def sets(self, many: list[str]) -> list[np.ndarray]:
        split = [text.lower().split() for text in many]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
            new = set().union(*split)
        for word in new:
            digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            self.known[word] = int.from_bytes(digest, "little")
        return [self.of(words) for words in split]

    def of(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        out = np.full(len(words) - n + 1, len(words) if len(words) < self.words else 0, np.uint64)
        for k in range(n):
            out = (out ^ hashes[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def labels_of(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> bytes:
    """One 64-bit label a tree, its first level in the highest byte."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        hashed = np.multiply.outer(factors, short[at : at + 512]) + offsets[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    # the least value is mixed before a byte is taken, as its own high bits are nearly all zero
    level = ((least * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8)
    return level.tobytes()


def signatures(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, set_hash (128 bits), shingles, labels of every document with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, random = Shingler(words), np.random.default_rng(20240501)
        factors = random.integers(0, 1 << 32, trees * LEVELS, dtype=np.uint32) | np.uint32(1)
        offsets = random.integers(0, 1 << 32, trees * LEVELS, dtype=np.uint32)
        names, kinds = ["doc_id", "set_hash", "shingles", "labels"], [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            doc_ids, whole = batch.column("doc_id").to_pylist(), texts(batch)
            for at in range(0, len(whole), 256):
                out = []
                found = shingler.sets(whole[at : at + 256])
                for doc_id, own in zip(doc_ids[at : at + 256], found, strict=True):
                    if len(own):
                        digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                        out.append((doc_id, digest, len(own), labels_of(own, factors, offsets)))
                if out:
                    yield batched(names, kinds, list(zip(*out, strict=True)))

    kept = docs.where("doc_id is not null").select("doc_id", "text")
    return kept.mapInArrow(run, "doc_id long, set_hash binary, shingles long, labels binary")


def candidates(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """Links (a, b) of sets that share a prefix in some tree, each to one set under that prefix."""
    shift = np.uint64(8 * (LEVELS - depth))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["tree", "prefix", "node", "near"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            nodes = np.asarray(batch.column("rep").to_pylist(), np.int64)
            if not len(nodes):
                continue
            table = np.frombuffer(b"".join(batch.column("labels").to_pylist()), ">u8").reshape(len(nodes), trees)
            table = (table.astype(np.uint64) >> shift).view(np.int64)
            for tree in range(trees):
                # sets that meet already in this batch are linked here; one of them travels on
                order = np.lexsort((nodes, table[:, tree]))
                values, own = table[order, tree], nodes[order]
                first = np.concatenate([[True], values[1:] != values[:-1]])
                leader = own[np.flatnonzero(first)][np.cumsum(first) - 1]
                yield batched(
                    names,
                    kinds,
                    [np.where(first, tree, -1), np.where(first, values, own), own, np.where(first, own, leader)],
                )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, 0
        for batch in batches:
            tree, prefix = (batch.column(n).to_numpy().astype(np.int64) for n in ("tree", "prefix"))
            node, near = (batch.column(n).to_numpy() for n in ("node", "near"))
            if not len(tree):
                continue
            first = np.concatenate([[True], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])])
            if last == (tree[0], prefix[0]):
                first[0] = False
            heads = np.concatenate([[leader], node[first]])
            to = np.where(tree >= 0, heads[np.cumsum(first)], near)
            last, leader = (tree[-1], prefix[-1]), int(heads[-1])
            keep = to != node
            yield batched(["a", "b"], [pa.int64()] * 2, [to[keep], node[keep]])

    rows = sets.select("rep", "labels").mapInArrow(prefixes, "tree int, prefix long, node long, near long")
    rows = rows.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", "node")
    return rows.mapInArrow(neighbours, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, by products of bounded slices of their incidence matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column_of = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], column_of[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return out


def verify(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts and labels of the exact links inside a block; of two different chunks only links across them."""
    block = block.drop_duplicates("rep")
    sets = [np.frombuffer(x, np.uint64) for x in block["shingles"]]
    sizes = np.array([len(s) for s in sets])
    common = overlaps(sets)
    # a / b >= t as a >= t * b, with room for the rounding of t * b
    linked = common * (1 + 1e-9) >= threshold * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    if block["i"].iloc[0] != block["j"].iloc[0]:
        chunk = block["chunk"].to_numpy()
        linked &= chunk[:, None] != chunk[None, :]
    nodes, copies = block["rep"].to_numpy(), block["copies"].to_numpy()
    label = nodes.copy()
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    out = pd.DataFrame({"rep": nodes, "links": linked @ copies, "label": label})
    return out[linked.any(axis=1)]


def near_classes(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    trees: int = 40,
    target: float = 0.9995,
    chunk: int = 256,
) -> DataFrame:
    """doc_id, class_id (smallest id of the linked class), n_links (documents at the threshold or above), n_shingles.

    target: probability that a pair just at the threshold becomes a candidate;
    more similar pairs are found more surely. chunk bounds the sets in one side of a
    verified block.
    """
    signed = materialise(signatures(docs, words, trees), "signatures")
    members = signed.groupBy("doc_id").agg(F.min(F.struct("set_hash", "shingles")).alias("m")).select("doc_id", "m.*")
    sets = signed.groupBy("set_hash").agg(
        F.min(F.struct("doc_id", "labels")).alias("least"), F.countDistinct("doc_id").alias("copies")
    )
    sets = materialise(sets.select("set_hash", "least.doc_id", "least.labels", "copies").withColumnRenamed("doc_id", "rep"), "sets")

    links = candidates(sets, trees, shared_depth(trees, threshold, target))
    near = components(links).withColumnRenamed("node", "rep")
    sized = near.join(near.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root")
    sized = sized.join(sets.select("rep", "copies"), "rep")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    near = materialise(sized.select("rep", "root", "copies", chunks.alias("chunks"), own.alias("chunk")), "near")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        names = ["rep", "root", "copies", "chunks", "chunk"]
        for batch in batches:
            whole = texts(batch)
            for at in range(0, len(whole), 256):
                found = [own.tobytes() for own in shingler.sets(whole[at : at + 256])]
                part = [batch.column(n).slice(at, 256) for n in names]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield batched([*names, "shingles"], kinds, [*part, found])

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in runs(batches, ["root", "i", "j"]):
            yield verify(block, threshold)

    whole = docs.select("doc_id", "text").join(near, F.col("doc_id") == F.col("rep"))
    shingled = whole.drop("doc_id").mapInArrow(
        shingle, "rep long, root long, copies long, chunks int, chunk int, shingles binary"
    )
    lower = F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    blocks = shingled.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        "root", *lower, "chunk", "rep", "copies", "shingles"
    )
    blocks = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep")
    found = materialise(blocks.mapInPandas(verified, "rep long, links long, label long"), "verified")

    classes = components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    state = sets.select("set_hash", "rep", "copies").join(counts, "rep", "left")
    state = state.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash",
        F.coalesce("root", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    linked = members.join(state, "set_hash").select("doc_id", "class_id", "n_links", F.col("shingles").alias("n_shingles"))
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    return ids.join(linked, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"),
    )


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """Of every class the document with the smallest id, with all columns; rows without an id stay."""
    own = free_name(docs, "gone")
    gone = near_classes(docs, **settings).where("doc_id <> class_id").select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
