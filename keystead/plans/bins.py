"""Rows as bytes for trees: every feature in bins, features that exclude each other in one column (A-M2, A-M3).

Trees of an ensemble need all rows, but little of them: the bin of every feature. The codes of a category fill one
feature at most, so they share a column, and a listing takes as many bytes as it had columns before the encoding.
A table of that size is dealt whole to every task that grows trees, which then needs no other task; only tables
above ``LOCAL_BYTES`` are trained on by histograms that tasks add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_BYTES = 500_000_000
BYTES_BESIDE = 150  # that training needs for a row besides its bins


@dataclass(frozen=True)
class Layout:
    """cuts: of every feature the values that end its bins but the last. column, first: of every feature its column, and
    the value there of its second bin; 0 stands for the first bins. sizes: the values of every column."""

    cuts: list[np.ndarray]
    column: np.ndarray
    first: np.ndarray
    sizes: np.ndarray

    @property
    def places(self) -> np.ndarray:
        """Bins of every feature but the first."""
        return np.array([len(c) for c in self.cuts], np.int64)

    @property
    def kind(self) -> type:
        return np.uint8 if self.sizes.max(initial=1) <= 256 else np.uint16 if self.sizes.max() <= 1 << 16 else np.int32

    def features(self, column: int) -> np.ndarray:
        """The feature that each value of a column is a bin of; for 0 the number of features."""
        out = np.full(self.sizes[column], len(self.cuts), np.int64)
        for f in np.flatnonzero(self.column == column):
            out[self.first[f] : self.first[f] + len(self.cuts[f])] = f
        return out

    def coded(self, x: np.ndarray) -> np.ndarray:
        """A row of bins for every row of values."""
        out = np.zeros((len(x), len(self.sizes)), self.kind, order="F")
        x = np.asfortranarray(x)
        for f, cuts in enumerate(self.cuts):
            if len(cuts):
                code = np.searchsorted(cuts, x[:, f], "left") if len(cuts) > 1 else x[:, f] > cuts[0]
                row = np.flatnonzero(code)
                out[row, self.column[f]] = self.first[f] - 1 + code[row]
        return np.ascontiguousarray(out)

    def fits(self, rows: int) -> bool:
        """Whether a task can hold so many rows and train on them."""
        return rows * (len(self.sizes) * np.dtype(self.kind).itemsize + BYTES_BESIDE) <= LOCAL_BYTES


def layout(cuts: list[np.ndarray], groups: list[range] = ()) -> Layout:
    """groups: features of which a row has one at most that is not zero, whatever the row."""
    column, first, sizes = np.zeros(len(cuts), np.int64), np.ones(len(cuts), np.int64), []
    together = [[f for f in g if len(cuts[f]) == 0 or cuts[f][0] >= 0] for g in groups]
    alone = sorted({*range(len(cuts))} - {f for g in together for f in g})
    for group in [*[[f] for f in alone], *[g for g in together if g]]:
        size = 1
        for f in group:
            column[f], first[f] = len(sizes), size
            size += len(cuts[f])
        sizes.append(size)
    return Layout(list(cuts), column, first, np.array(sizes))


def cut_points(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """For every feature the values that end its bins but the last: between all its values if they are no more than the
    bins, else at quantiles."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.asfortranarray(_matrix(batch.column(0)))
            for f in range(x.shape[1]):
                if f not in known or len(known[f]) <= bins:
                    known[f] = np.unique(np.append(known.get(f, []), x[:, f]))[: bins + 1]
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([*known], pa.int32()), pa.array([v.tolist() for v in known.values()], pa.list_(pa.float64()))], ["at", "values"])

    vectors = rows.select(vector_to_array("features").alias("x"))
    found: dict[int, np.ndarray] = {}
    for at, some in vectors.mapInArrow(values, "at int, values array<double>").collect():
        found[at] = np.unique(np.append(found.get(at, []), some))
    cuts = [(v[1:] + v[:-1]) / 2 for _, v in sorted(found.items())]
    many = [f for f, v in enumerate(cuts) if len(v) >= bins]
    if many:
        cells = vectors.select(F.explode(F.array(*[F.struct(F.lit(f).alias("at"), F.col("x")[f].alias("x")) for f in many])).alias("cell"))
        shares = [k / bins for k in range(1, bins)]
        for at, ends, most in cells.groupBy("cell.at").agg(F.percentile_approx("cell.x", shares, 10_000), F.max("cell.x")).collect():
            cuts[at] = np.unique([x for x in ends if x < most])
    return cuts


def _matrix(arrays: pa.Array) -> np.ndarray:
    """A row for every list; the lists are of one length."""
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arrays), -1)


def _array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


@dataclass
class Rows:
    """Rows with a number each, their label, the fits they train, the fits they test, and their bins."""

    ids: np.ndarray
    label: np.ndarray
    trains: np.ndarray
    tests: np.ndarray
    codes: np.ndarray


def packed(rows: DataFrame, how: Layout, ids: Column, label: Column, trains: list[Column] = (), tests: list[Column] = ()) -> RDD:
    """(partition, number) and the ``Rows`` of every batch of ``rows``."""
    widths = len(trains), len(tests)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not len(batch):
                continue
            if batch.column(1).null_count:
                raise ValueError("a label is missing")
            flags = [np.packbits(_matrix(batch.column(k)).astype(bool)).tobytes() if width else b"" for k, width in zip((2, 3), widths, strict=True)]
            cells = [_array(batch.column(0)).astype(np.int64).tobytes(), _array(batch.column(1)).astype(float).tobytes(), *flags, how.coded(_matrix(batch.column(4))).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([len(batch)]), *[pa.array([c], pa.binary()) for c in cells]], ["part", "number", "size", "ids", "label", "trains", "tests", "codes"])
            number += 1

    def flags(conditions: list[Column]) -> Column:
        return F.array(*[F.coalesce(c, F.lit(False)) for c in conditions]) if conditions else F.array().cast("array<boolean>")

    def unpacked(row) -> tuple:
        part, number, size, ids, label, train, test, codes = row
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=size * width).astype(bool).reshape(size, width) for b, width in zip((train, test), widths, strict=True)]
        return (part, number), Rows(np.frombuffer(ids, np.int64), np.frombuffer(label), *bits, np.frombuffer(codes, how.kind).reshape(size, -1))

    chosen = rows.select(F.coalesce(ids, F.lit(0)).cast("long").alias("id"), label.cast("double").alias("label"), flags(trains).alias("trains"), flags(tests).alias("tests"), vector_to_array("features").alias("x"))
    schema = "part long, number long, size long, ids binary, label binary, trains binary, tests binary, codes binary"
    return chosen.mapInArrow(pack, schema).rdd.map(unpacked)


def gathered(part: Iterator) -> Rows | None:
    """The batches that a task got, in order: the same in every task. Repeated numbers of rows become different ones."""
    got = [rows for _, rows in sorted((one for _, one in part), key=lambda one: one[0])]
    if not got:
        return None
    whole = Rows(*[np.concatenate([getattr(one, name) for one in got]) for name in ("ids", "label", "trains", "tests", "codes")])
    order = np.argsort(whole.ids, kind="stable")
    ids = whole.ids[order]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    again = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    whole.ids = whole.ids.copy()
    whole.ids[order] = ids + (again << 40)
    return whole


def to_every(batches: RDD, tasks: int) -> RDD:
    """All batches in every one of so many tasks."""
    return batches.flatMap(lambda one: [(k, one) for k in range(tasks)]).partitionBy(tasks, int)


def measures(label: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Sums of which ``outcome`` makes R² of the log price, R² of the price and the mean absolute error of the price."""
    price, guess = np.expm1(label), np.expm1(score)
    return np.array([
        len(label), label.sum(), (label * label).sum(), ((label - score) ** 2).sum(), price.sum(), (price * price).sum(),
        ((price - guess) ** 2).sum(), np.abs(price - guess).sum(),
    ])


def outcome(sums: np.ndarray) -> tuple[float, float, float]:
    n, y, yy, se, p, pp, pse, ae = sums
    return float(1 - se / (yy - y * y / n)), float(1 - pse / (pp - p * p / n)), float(ae / n)
