"""Operator 10, language-model scores from a hierarchical Pitman-Yor model.

Every token is a dish in the restaurant of its context, and all context
restaurants share one parent restaurant of single words, whose base is uniform
over the vocabulary and one unknown word. A context is the single word before
(the first word of a text follows an end token). Gibbs sampling seats the
customers of every context anew, one after the other, given the parent and the
totals of the sweep before; tables of contexts are the customers of the parent.
Tables and parent probabilities are averaged over the samples, which leaves
probabilities that sum to one in every context.

Counts cover all training texts. Words are 64-bit hashes (a collision among a
hundred million words has a chance of one in four thousand), contexts the first
40 bits of them (of ten million words, one in a hundred thousand shares its context).
All counts of a word lie in one place, and so do the totals of a context: in a
sweep the places of words send the tables of each of their contexts to the
places of contexts and get the totals back. A pair of words that occurs once has one
table whatever is drawn, so such pairs wait outside the sweeps as one number per
word and context. Only sums over everything pass through the driver. Texts are
tokenised twice: once for counts that are summed per block of documents, once
for scoring, some documents after the others, where tokens travel in arrays to the words' part of the model and
sums per document travel back; what a context leaves to unseen words is asked of the
contexts' part. Parts are salted by block, so that a part with a hot word is spread
among tasks.

Defined cases: null, empty and blank texts are the end token alone; without
training texts every word is unknown with probability 1; rows are scored one by
one, also repeated ones; a null id stays null and counts as empty text where ids
are split; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import batched, discard, materialise, texts
from keystead.storage import delete, shuffles_freed

END = b"\n"
CONTEXT_BITS = 40
START = xxhash.xxh64_intdigest(END) >> (64 - CONTEXT_BITS)
ONCE = 1 << CONTEXT_BITS  # in place of a context: all pairs of a word that occur once
TURNS = 3  # parts of the model are settled, and documents scored, in so many turns: each frees its shuffles
BLOCKS_COUNTED = 2  # blocks whose pairs are counted together
# kinds of rows, in the order in which a task needs them
REPLY, STATE, SINGLE, CONTEXT, ASK, WORDS, PAIRS, TOKENS, HEAD = range(9)


@dataclass(frozen=True)
class Settings:
    burn_in: int = 1
    samples: int = 3
    strength: float = 1.0
    parts: int = 128
    block_tokens: int = 600_000
    seed: int = 11


class Block:
    """Tokens of some documents as word hashes with the context and document of each."""

    def __init__(self, many: list[np.ndarray]):
        self.lengths = np.array([len(own) for own in many], np.int64)
        self.hashes = np.concatenate(many)
        self.docs = np.repeat(np.arange(len(many), dtype=np.uint16), self.lengths)
        self.context = np.empty(len(self.hashes), np.uint64)
        self.context[1:] = self.hashes[:-1] >> np.uint64(64 - CONTEXT_BITS)
        self.context[np.cumsum(self.lengths) - self.lengths] = START


def packed(context: np.ndarray) -> bytes:
    """Contexts in five bytes each."""
    return np.ascontiguousarray(context, "<u8").view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8].tobytes()


def unpacked(data: bytes | None) -> np.ndarray:
    short = read(data, np.uint8).reshape(-1, CONTEXT_BITS // 8)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, : CONTEXT_BITS // 8] = short
    return out.view("<u8").ravel()


def blocks(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[list, list, Block]]:
    """ids, held-out marks and tokens of consecutive documents; a block is closed when it has enough tokens."""
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            columns = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts(batch)
            for doc_id, out, text in zip(*columns, strict=True):
                # bytes lower and split by ASCII alone
                own = text.encode("utf-8", "surrogatepass").lower().split()
                own.append(END)
                for column, value in zip(
                    held, (doc_id, out, np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))), strict=True
                ):
                    column.append(value)
                size += len(own)
                if size >= settings.block_tokens or len(held[0]) >= 60_000:
                    yield held[0], held[1], Block(held[2])
                    held, size = ([], [], []), 0
    if held[0]:
        yield held[0], held[1], Block(held[2])


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and the starts of their runs."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def by_pair(hashes: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Order by word, then context: two sorts of one number each take about half the time of one by two keys."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    rank = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])[: len(order)]).astype(np.uint64)
    if len(rank) and int(rank[-1]) >> (63 - CONTEXT_BITS):  # the number of a word and ONCE as context fill 64 bits
        return np.lexsort((context, hashes))
    return order[np.argsort(rank << np.uint64(CONTEXT_BITS + 1) | context[order].astype(np.uint64))]


def runs_of(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ordered))).astype(np.uint32)


class Counts:
    """Entries (word, context, count), sorted; the form in which counts travel and are kept."""

    def __init__(self, hashes: np.ndarray, context: np.ndarray, counts: np.ndarray):
        order = by_pair(hashes, context)
        hashes, context, counts = hashes[order], context[order], counts[order]
        first = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (context[1:] != context[:-1])])
        starts = np.flatnonzero(first)
        self.entry_hash, self.context = hashes[starts], context[starts]
        self.counts = np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def by_place(keys: np.ndarray, places: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each place that holds some of the keys, and where these are, in their order."""
    place = (keys % np.uint64(places)).astype(np.uint16 if places <= 1 << 16 else np.uint64)
    order, starts = grouped(place)
    if len(order):
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            yield int(place[order[lo]]), order[lo:hi]


def added(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of each array of values over them."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(at, v, len(distinct)).astype(np.int64) for v in values)


NAMES = ["part", "salt", "kind", "block", "a", "b", "c", "d", "e", "f"]
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6
SCHEMA = "part int, salt int, kind int, block long, " + ", ".join(f"{c} binary" for c in "abcdef")


def row(part=0, salt=0, kind=0, block=0, *arrays) -> list:
    data = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    return [int(part), int(salt), int(kind), int(block), *data, *[None] * (6 - len(data))]


def in_batches(rows_of: Callable) -> Callable:
    """The rows that a function yields in batches of some megabytes, as a batch a row costs more than its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for one in rows_of(batches):
            held.append(one)
            size += sum(len(x) for x in one[4:] if x)
            if size > 2_000_000 or len(held) == 512:
                yield batched(NAMES, TYPES, [list(x) for x in zip(*held, strict=True)])
                held, size = [], 0
        if held:
            yield batched(NAMES, TYPES, [list(x) for x in zip(*held, strict=True)])

    return run


def together(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of each key, one by one, from batches sorted by the keys."""
    from itertools import groupby

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    yield from groupby(rows(), lambda r: tuple(r[key] for key in keys))


def read(data: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(data or b"", kind)


def counted(docs: DataFrame, settings: Settings, fine: int) -> DataFrame:
    """What the training texts alone tell, in ``fine`` parts of words and as many of contexts.

    STATE: the model before sampling, where pairs that occur once are one entry a word; SINGLE: these pairs;
    CONTEXT: customers and pairs that occur once of contexts, as far as the words of one part go.
    """
    large = replace(settings, block_tokens=BLOCKS_COUNTED * settings.block_tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for _, _, block in blocks(batches, large):
            own = Counts(block.hashes, block.context, np.ones(len(block.hashes), np.int64))
            for part, at in by_place(own.entry_hash, fine):
                words, sizes = runs_of(own.entry_hash[at])
                yield row(part, 0, 0, 0, words, sizes, packed(own.context[at]), own.counts[at].astype(np.uint32))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for (part,), rows in together(batches, ["part"]):
            parts = [
                (np.repeat(read(r["a"], np.uint64), read(r["b"], np.uint32)), unpacked(r["c"]), read(r["d"], np.uint32))
                for r in rows
            ]
            hashes, context, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            whole = Counts(hashes, context, counts.astype(np.int64))
            once = whole.counts == 1
            words, sizes = runs_of(whole.entry_hash[once])
            merged = Counts(
                np.concatenate([whole.entry_hash[~once], words]),
                np.concatenate([whole.context[~once], np.full(len(words), ONCE, np.uint64)]),
                np.concatenate([whole.counts[~once], sizes.astype(np.int64)]),
            )
            # rows of a few hundred kilobytes, cut between words, are easier on the JVM than one large row
            first = np.flatnonzero(np.concatenate([[True], merged.entry_hash[1:] != merged.entry_hash[:-1]]))
            cuts = [0, *first[np.unique(np.searchsorted(first, range(8192, len(merged.counts), 8192), "right") - 1)]]
            for lo, hi in zip(cuts, [*cuts[1:], len(merged.counts)], strict=True):
                if lo < hi:
                    # every dish starts at one table, in its contexts and in the parent
                    tables = np.where(merged.context[lo:hi] == ONCE, merged.counts[lo:hi], 1)
                    parents = np.ones(np.searchsorted(first, hi) - np.searchsorted(first, lo), np.int64)
                    yield row(
                        part, 0, STATE, 0, merged.entry_hash[lo:hi], merged.context[lo:hi], merged.counts[lo:hi],
                        tables, parents, b"",
                    )
            single, context = whole.entry_hash[once], whole.context[once]
            for lo in range(0, len(single), 32_768):
                words, sizes = runs_of(single[lo : lo + 32_768])
                yield row(part, 0, SINGLE, 0, words, sizes, packed(context[lo : lo + 32_768]))
            known, customers, ones = added(whole.context, whole.counts, once)
            for place, at in by_place(known, fine):
                yield row(place, 0, CONTEXT, 0, packed(known[at]), customers[at], ones[at])

    training = docs.where("not held_out").mapInArrow(in_batches(count), SCHEMA)
    return met(training).mapInArrow(in_batches(merge), SCHEMA)


def written(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """A written table, with a folder for each value of a column if told so; what was shuffled for it is freed."""
    with shuffles_freed(rows.sparkSession):
        return materialise(rows, name, by)


def of_kind(rows: DataFrame, kind: int) -> DataFrame:
    """Rows of a table that is written by kind."""
    return rows.where(F.col("kind") == kind).select(NAMES)


def spent(rows: DataFrame, kind: int) -> None:
    """Delete the rows of one kind of such a table, as nothing will read them again."""
    delete(rows.sparkSession, f"{rows.written_to}/kind={kind}")


def met(*many: DataFrame) -> DataFrame:
    """Rows of all tables, those of a part together and by kind; a task takes several parts, one after the other."""
    rows = many[0]
    for more in many[1:]:
        rows = rows.unionByName(more)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "kind")


def contexts_of(found: DataFrame) -> DataFrame:
    """Customers, and pairs that occur once, of every context: a row for each part."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for (part,), rows in together(batches, ["part"]):
            parts = [(unpacked(r["a"]), read(r["b"], np.int64), read(r["c"], np.int64)) for r in rows]
            known, customers, ones = added(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield row(part, 0, CONTEXT, 0, packed(known), customers, ones)

    return met(found).mapInArrow(in_batches(merge), SCHEMA)


def totals_for(states: DataFrame, contexts: DataFrame, fine: int, samples: int = 0) -> DataFrame:
    """REPLY rows for the parts of ``states``: customers and tables of their contexts.

    With ``samples`` the tables are summed over that many samples, pairs that occur once (SINGLE) get replies too,
    and every part of contexts also gives its own totals (CONTEXT).
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for (part,), rows in together(batches, ["part"]):
            context, tables = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for r in rows:
                if r["kind"] == SINGLE:
                    context.append(unpacked(r["c"]))
                    tables.append(np.zeros(len(context[-1]), np.int64))
                else:
                    s = State(r)
                    own = s.context != ONCE
                    context.append(s.context[own])
                    tables.append((s.taken if samples else s.tables)[own])
            known, total = added(np.concatenate(context), np.concatenate(tables))
            for place, at in by_place(known, fine):
                yield row(place, part, ASK, 0, packed(known[at]), total[at])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for (part,), rows in together(batches, ["part"]):
            kept = next(rows)
            known, customers, ones = unpacked(kept["a"]), read(kept["b"], np.int64), read(kept["c"], np.int64)
            asks = [(r["salt"], np.searchsorted(known, unpacked(r["a"])), read(r["b"], np.int64)) for r in rows]
            tables = ones * max(samples, 1)
            for _, at, own in asks:
                tables[at] += own  # contexts of an ask are distinct
            for sender, at, _ in asks:
                yield row(sender, 0, REPLY, 0, packed(known[at]), customers[at], tables[at])
            if samples:
                yield row(part, 0, CONTEXT, 0, packed(known), customers, tables)

    return met(contexts, states.mapInArrow(in_batches(ask), SCHEMA)).mapInArrow(in_batches(answer), SCHEMA)


class Replies:
    """Customers and tables of the contexts of one part."""

    def __init__(self, rows: list[dict]):
        parts = [(unpacked(r["a"]), read(r["b"], np.int64), read(r["c"], np.int64)) for r in rows]
        known, customers, tables = (np.concatenate([*x, x[0][:0]]) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
        order = np.argsort(known, kind="stable")
        self.known, self.customers, self.tables = known[order], customers[order], tables[order]

    def find(self, context: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.known, context)


@dataclass
class Totals:
    """Sums over all words: customers and tables of the contexts (of each, or of all together) and of the parent,
    and the vocabulary."""

    customers: np.ndarray
    tables: np.ndarray
    parent_tables: float
    words: float
    single: np.ndarray
    discount: float = 0.5
    parent_discount: float = 0.5

    @property
    def tokens(self) -> float:
        return float(self.customers.sum())


class State:
    """Some words of one part of the model."""

    def __init__(self, r: dict):
        self.hash = read(r["a"], np.uint64)
        self.context = np.frombuffer(r["b"], f"u{len(r['b']) // max(1, len(self.hash)) or 8}")
        self.counts, self.tables = read(r["c"], np.int64), read(r["d"], np.int64)
        self.parent_tables = read(r["e"], np.int64)
        first = np.concatenate([[True], self.hash[1:] != self.hash[:-1]]) if len(self.hash) else np.zeros(0, bool)
        self.starts = np.flatnonzero(first)
        self.word = np.cumsum(first) - 1
        # sums over the samples so far: tables of every entry, then the probability of every word in the parent
        held = read(r["f"], np.float64) if r["f"] else np.zeros(len(self.hash) + len(self.starts))
        self.taken, self.parents = held[: len(self.hash)], held[len(self.hash) :]

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else values[:0]

    def parent(self, t: Totals, strength: float) -> np.ndarray:
        customers = self.by_word(self.tables)
        total = strength + t.tables.sum()
        new = (strength + t.parent_discount * t.parent_tables) / total / (t.words + 1)
        return (customers - t.parent_discount * self.parent_tables) / total + new

    def predict(self, t: Totals, strength: float) -> tuple[np.ndarray, np.ndarray]:
        parent = self.parent(t, strength)
        own = t.customers[self.context], t.tables[self.context]
        return predicted(self.counts, self.tables, *own, parent[self.word], t.discount, strength), parent


def predicted(counts, tables, customers, all_tables, parent, discount: float, strength: float) -> np.ndarray:
    """Probability of an entry, given the customers and tables of its context and the parent's probability of its word."""
    return (counts - discount * tables + (strength + discount * all_tables) * parent) / (strength + customers)


def seated(counts: np.ndarray, discount: float, new: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Tables after the customers of each dish sat down one after the other.

    new: weight of a new table. From sixteen customers on, an eighth of those
    seated sit down at once under one probability, so a dish of any size takes
    a number of draws that grows with its logarithm.
    """
    tables, done = np.ones(len(counts), np.int64), np.ones(len(counts), np.int64)
    active = np.flatnonzero(counts > 1)
    while len(active):
        sat, own = done[active], tables[active]
        step = np.minimum(np.maximum(1, sat // 8), counts[active] - sat)
        weight = new[active] if new.ndim else new
        chance = weight / (weight + np.maximum(sat - discount * own, 1e-12))
        tables[active] += random.binomial(step, chance)
        done[active] += step
        active = active[done[active] < counts[active]]
    return tables


def sums(states: DataFrame) -> Totals:
    """Totals over all parts, summed on the executors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.zeros(8)
        for _, rows in together(batches, ["part"]):
            for r in rows:
                s = State(r)
                once = s.context == ONCE
                fresh = s.by_word(s.tables)
                values += [
                    s.counts.sum(), s.tables.sum(), s.parent_tables.sum(), len(s.starts), s.counts[once].sum(),
                    (s.counts[~once] == 2).sum(), (fresh == 1).sum(), (fresh == 2).sum(),
                ]
        yield batched(["at", "value"], [pa.int64(), pa.float64()], [np.arange(len(values)), values])

    found = states.mapInArrow(part, "at long, value double").groupBy("at").agg(F.sum("value")).collect()
    values = np.zeros(8)
    for at, value in found:
        values[at] = value
    return Totals(values[:1], values[1:2], values[2], values[3], values[4:])


def swept(states: DataFrame, t: Totals, settings: Settings, sweep: int) -> DataFrame:
    """Add the sample at hand to the sums, if it counts, and seat all customers anew, but after the last sample.

    The totals of contexts stand before the states of their part, in REPLY rows.
    """
    strength, take, last = settings.strength, sweep > settings.burn_in, sweep == settings.burn_in + settings.samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for (part,), rows in together(batches, ["part"]):
            told: list[dict] = []
            replies = None
            for r in rows:
                if r["kind"] == REPLY:
                    told.append(r)
                    continue
                if replies is None:
                    replies, told = Replies(told), []
                s = State(r)
                kept = r["f"]
                if take:
                    kept = np.concatenate([s.taken + s.tables, s.parents + s.parent(t, strength)])
                tables, parents = s.tables, s.parent_tables
                if not last:
                    random = np.random.default_rng([settings.seed, sweep, int(s.hash[0])])
                    real = s.context != ONCE
                    above = s.parent(t, strength)[s.word[real]]
                    new = (strength + t.discount * replies.tables[replies.find(s.context[real])]) * above
                    tables = tables.copy()
                    tables[real] = seated(s.counts[real], t.discount, new, random)
                    base = np.array((strength + t.parent_discount * t.parent_tables) / (t.words + 1))
                    parents = seated(s.by_word(tables), t.parent_discount, base, random)
                yield row(part, 0, STATE, 0, s.hash, r["b"], s.counts, tables, parents, kept)

    return states.mapInArrow(in_batches(run), SCHEMA)


def settled(rows: DataFrame, t: Totals, settings: Settings) -> DataFrame:
    """WORDS: counts and parent probabilities; PAIRS: probabilities; both as means over the samples."""
    strength, samples = settings.strength, settings.samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for (part,), own in together(batches, ["part"]):
            told: list[dict] = []
            replies, words, parents = None, [], []
            for r in own:
                if r["kind"] == REPLY:
                    told.append(r)
                    continue
                if replies is None:
                    replies, told = Replies(told), []
                if r["kind"] == STATE:
                    s = State(r)
                    hashes, above = s.hash[s.starts], s.parents / samples
                    words.append(hashes)
                    parents.append(above)
                    yield row(part, 0, WORDS, 0, hashes, s.by_word(s.counts), above)
                    real = s.context != ONCE
                    entry, context, above = s.hash[real], s.context[real], above[s.word[real]]
                    counts, tables = s.counts[real], s.taken[real] / samples
                else:
                    if len(words) > 1 or not np.array_equal(words[0], np.sort(words[0])):
                        every = np.concatenate(words)
                        order = np.argsort(every)
                        words, parents = [every[order]], [np.concatenate(parents)[order]]
                    entry, context = np.repeat(read(r["a"], np.uint64), read(r["b"], np.uint32)), unpacked(r["c"])
                    above = parents[0][np.searchsorted(words[0], entry)]
                    counts = tables = 1
                at = replies.find(context)
                mean = predicted(
                    counts, tables, replies.customers[at], replies.tables[at] / samples, above, t.discount, strength
                )
                yield row(part, 0, PAIRS, 0, *runs_of(entry), packed(context), mean.astype(np.float32))

    return rows.mapInArrow(in_batches(run), SCHEMA)


@dataclass
class Fitted:
    """rows: WORDS and PAIRS by part of the words, CONTEXT by part of the contexts; tables: where they are written."""

    rows: DataFrame
    tables: list[DataFrame]
    tokens: float
    words: float
    discount: float
    unknown: float


def fit(docs: DataFrame, settings: Settings, fine: int) -> Fitted:
    """The model from the rows (doc_id, text, held_out) that are not held out."""
    found = written(counted(docs, settings, fine), "lm-counts", "kind")
    states, once, shares = (of_kind(found, kind) for kind in (STATE, SINGLE, CONTEXT))
    contexts = written(contexts_of(shares), "lm-contexts")
    spent(found, CONTEXT)
    unknown, discounts = [], None
    for sweep in range(settings.burn_in + settings.samples + 1):
        t = sums(states)
        if discounts is None:
            # discounts from the words seen once and twice
            ones, twos, parent_ones, parent_twos = t.single
            discounts = [np.clip(a / max(a + 2 * b, 1), 0.05, 0.95) for a, b in ((ones, twos), (parent_ones, parent_twos))]
        t.discount, t.parent_discount = map(float, discounts)
        if sweep > settings.burn_in:
            total = settings.strength + t.tables.sum()
            unknown.append((settings.strength + t.parent_discount * t.parent_tables) / total / (t.words + 1))
        last = sweep == settings.burn_in + settings.samples
        rows = states if last else met(states, totals_for(states, contexts, fine))
        old, states = states, written(swept(rows, t, settings, sweep), "lm-state")
        if sweep:
            discard(old)
        else:
            spent(found, STATE)
    told = written(totals_for(states.unionByName(once), contexts, fine, settings.samples), "lm-totals", "kind")
    discard(contexts)
    # some parts of the model after the others, as the shuffle of a part is larger than the part
    tables = [of_kind(told, CONTEXT)]
    for turn in range(TURNS):
        needed = (x.where(F.col("part") % TURNS == turn) for x in (states, once, of_kind(told, REPLY)))
        tables.append(written(settled(met(*needed), t, settings), "lm-model"))
    spent(told, REPLY)
    for table in (states, found):
        discard(table)
    return Fitted(reduce(DataFrame.unionByName, tables), [told, *tables[1:]], t.tokens, t.words, t.discount, float(np.mean(unknown)))


class Part:
    """The fitted model of one part of the words and one part of the contexts."""

    def __init__(self, rows: list[dict], settings: Settings, discount: float):
        join = lambda arrays, kind: np.concatenate([*arrays, np.zeros(0, kind)]).astype(kind)
        words, pairs, contexts = ([r for r in rows if r["kind"] == kind] for kind in (WORDS, PAIRS, CONTEXT))
        hashes = join([read(r["a"], np.uint64) for r in words], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        # the last word is the unknown one
        self.counts = np.append(join([read(r["b"], np.int64) for r in words], np.float64)[order], 0)
        self.parents = join([read(r["c"], np.float64) for r in words], np.float64)[order]
        keys = [
            np.repeat(np.searchsorted(self.hashes, read(r["a"], np.uint64)), read(r["b"], np.uint32)) << CONTEXT_BITS
            | unpacked(r["c"]).astype(np.int64)
            for r in pairs
        ]
        keys, means = join(keys, np.int64), join([read(r["d"], np.float32) for r in pairs], np.float32)
        order = np.argsort(keys)
        self.keys, self.means = keys[order], means[order]
        known = join([unpacked(r["a"]) for r in contexts], np.uint64)
        customers, tables = (join([read(r[c], np.int64) for r in contexts], np.float64) for c in "bc")
        left = (settings.strength + discount * tables / settings.samples) / (settings.strength + customers)
        order = np.argsort(known)
        # what a context leaves to words not seen behind it; all, if it was never seen
        self.contexts, self.left = known[order], np.log10(left[order])

    def leaves(self, context: np.ndarray) -> np.ndarray:
        return looked_up(self.contexts, self.left, context)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        found = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        return np.where(found, at, len(self.hashes))

    def entry(self, words: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = words << CONTEXT_BITS | context.astype(np.int64)
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.means[at].astype(np.float64)


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def score(docs: DataFrame, held_out: Column, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    held_out: a column expression; the model learns from the other rows. Scores
    are log10 probabilities of whole texts; base_score is that of single words
    with one added to every count. perplexity is 10 ** (-score / n_tokens).
    """
    s = settings or Settings()
    spark = docs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Scoring takes about as many tasks as there are shuffle partitions: parts of words times groups of blocks. Each part
    # sends sums for every block back, each group holds a copy of the model, so both grow with the root of the tasks.
    parts = s.parts * math.ceil(math.sqrt(max(1, wide / s.parts)))
    salts = -(-wide // parts)
    fine = parts * salts
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = fit(marked, s, fine)
    tokens, vocabulary, discount, unknown = model.tokens, model.words, model.discount, model.unknown

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        first = TaskContext.get().partitionId() << 32
        for number, (doc_ids, held, block) in enumerate(blocks(batches, s)):
            at = first + number
            missing = np.array([x is None for x in doc_ids], np.uint8)
            ids = np.array([x or 0 for x in doc_ids], np.int64)
            yield row(at % parts, number % salts, HEAD, at, ids, block.lengths, np.array(held, np.uint8), missing)
            # pairs of training texts are all known: contexts of held-out texts alone may meet words not seen behind them
            asked = np.unique(block.context[np.array(held, bool)[block.docs]])
            for part, own in by_place(asked, parts):
                yield row(part, number % salts, ASK, at, packed(asked[own]))
            # a pair of words goes once a block, with the documents of its tokens
            order = by_pair(block.hashes, block.context)
            hashes, context, docs = block.hashes[order], block.context[order], block.docs[order]
            starts = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (context[1:] != context[:-1])]))
            times = np.diff(np.append(starts, len(order)))
            entry, context = hashes[starts], context[starts]
            for part, own in by_place(entry, parts):
                sizes = times[own]
                inside = np.arange(sizes.sum()) + np.repeat(starts[own] - np.cumsum(sizes) + sizes, sizes)
                yield row(
                    part, number % salts, TOKENS, at, *runs_of(entry[own]), packed(context[own]), sizes.astype(np.uint32), docs[inside]
                )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for _, rows in together(batches, ["part", "salt"]):
            held: list[dict] = []
            contexts: list[dict] = []
            part = leaves = None
            for r in rows:
                if r["kind"] in (CONTEXT, WORDS, PAIRS):
                    (contexts if r["kind"] == CONTEXT else held).append(r)
                    continue
                if r["kind"] == HEAD:
                    yield row(0, 0, HEAD, r["block"], r["a"], r["b"], r["c"], r["d"])
                    continue
                if r["kind"] == ASK:
                    if leaves is None:
                        leaves = Part(contexts, s, discount).leaves
                    yield row(0, 0, ASK, r["block"], r["a"], leaves(unpacked(r["a"])))
                    continue
                if part is None:
                    part, held = Part(held, s, discount), []
                    above = np.log10(np.append(part.parents, unknown))
                times, context = read(r["d"], np.uint32), unpacked(r["c"])
                words = np.repeat(part.find(read(r["a"], np.uint64)), read(r["b"], np.uint32))
                seen, mean = part.entry(words, context)
                doc, words, seen, mean, context = read(r["e"], np.uint16), *(np.repeat(x, times) for x in (words, seen, mean, context))
                counts = part.counts[words]
                present = np.flatnonzero(np.bincount(doc))
                base = np.bincount(doc, np.log10((counts + 1) / (tokens + vocabulary + 1)))
                whole = np.bincount(doc, np.where(seen, np.log10(np.where(seen, mean, 1)), above[words]))
                yield row(
                    0, 0, TOKENS, r["block"], base[present], whole[present].astype(np.float32),
                    np.bincount(doc, counts > 0)[present].astype(np.uint32), present.astype(np.uint16),
                    packed(context[~seen]), doc[~seen],
                )

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in together(batches, ["block"]):
            base = whole = known = np.zeros(60_000)
            base, whole, known = base.copy(), whole.copy(), known.copy()
            head = None
            told, unseen = [], []
            for r in rows:
                if r["kind"] == HEAD:
                    head = r
                    continue
                if r["kind"] == ASK:
                    told.append((unpacked(r["a"]), read(r["b"], np.float64)))
                    continue
                unseen.append((unpacked(r["e"]), read(r["f"], np.uint16)))
                for total, data, kind in ((base, "a", np.float64), (whole, "b", np.float32), (known, "c", np.uint32)):
                    total[read(r["d"], np.uint16)] += read(r[data], kind)
            if told:
                asked, left = (np.concatenate(x) for x in zip(*told, strict=True))
                order = np.argsort(asked)
                context, doc = (np.concatenate(x) for x in zip(*unseen, strict=True))
                whole += np.bincount(doc, looked_up(asked[order], left[order], context), len(whole))
            missing = read(head["d"], np.uint8)
            ids = [None if gone else x for x, gone in zip(read(head["a"], np.int64).tolist(), missing, strict=True)]
            n = len(ids)
            yield batched(
                names,
                kinds,
                [ids, read(head["c"], np.uint8).astype(bool), read(head["b"], np.int64), known[:n].astype(np.int64),
                 [int(tokens)] * n, base[:n], whole[:n]],
            )

    copies = model.rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.withColumn("part", (F.col("part") % parts).cast("int")).select(NAMES)
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(some: DataFrame) -> DataFrame:
        rows = some.mapInArrow(in_batches(deal), SCHEMA).unionByName(copies).repartition(parts * salts, "part", "salt")
        rows = rows.sortWithinPartitions("part", "salt", "kind").mapInArrow(in_batches(judge), SCHEMA)
        rows = rows.select("block", "kind", *"abcdef").repartition("block").sortWithinPartitions("block")
        return rows.mapInArrow(gather, shape)

    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(TURNS))
    scores = [written(scored(marked.where(turn == k)), "lm-scores") for k in range(TURNS)]
    for table in model.tables:
        discard(table)
    return reduce(DataFrame.unionByName, scores)
