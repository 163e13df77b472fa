"""Operator 9, packing of tokenised documents into sequences of balanced cost.

A document is tokenised, closed with an end token and cut into pieces of at most
``capacity`` tokens. A task packs its own documents as it reads them: no text or
token is shuffled. Pieces wait in a window of bounded size; a full window opens
as many sequences as its tokens fill, takes the pieces in descending length and
puts each into the sequence of the lowest cost so far that has room, where a
piece of n tokens costs n + n * n / capacity (linear layers plus attention).
Room that is left over is filled by cutting the pieces that found none, so these
sequences are exactly full. What remains goes into the next window, and at
the end of the task into sequences whose lengths are powers of two, which need
no padding.

Defined cases: null and empty texts are the end token alone; repeated rows are
packed as often as they occur; a null id stays null; other columns are not read;
an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from keystead.llm.common import batched, texts
from keystead.llm.tokens import encoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
TYPES = [pa.int64()] * len(NAMES)


def cost(length, capacity: int):
    return length + length * length / capacity


class Window:
    """Pieces (doc_id, start, ids, doc_tokens) that wait for a sequence; ids are bytes, four a token."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.pieces: list[tuple] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity
        whole = total // step * step
        for start in range(0, whole, step):
            self.place((doc_id, start, ids[4 * start : 4 * (start + step)], total), self.sequence, 0)
            self.sequence += 1
        if total > whole:
            self.pieces.append((doc_id, whole, ids[4 * whole :], total))
            self.tokens += total - whole

    def place(self, piece: tuple, sequence: int, offset: int) -> None:
        doc_id, start, ids, total = piece
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def fill(self, room: list[int]) -> None:
        """Fill sequences of the given sizes, together at most the waiting tokens, to the last token."""
        if not room:
            return
        first, sizes = self.sequence, np.array(room)
        self.sequence += len(room)
        left, costs = sizes.copy(), np.zeros(len(room))
        spare = []
        # ties in length go by id and start, so a task that runs again packs alike
        for piece in sorted(self.pieces, key=lambda p: (-len(p[2]), p[0] is None, p[0] or 0, p[1])):
            n = len(piece[2]) // 4
            open_ = np.flatnonzero(left >= n)
            if not len(open_):
                spare.append(piece)
                continue
            at = open_[np.argmin(costs[open_])]
            self.place(piece, int(first + at), int(sizes[at] - left[at]))
            left[at] -= n
            costs[at] += cost(n, self.capacity)
        for at in np.flatnonzero(left):
            while left[at]:
                doc_id, start, ids, total = spare.pop()
                cut = ids[: 4 * int(left[at])]
                self.place((doc_id, start, cut, total), int(first + at), int(sizes[at] - left[at]))
                left[at] -= len(cut) // 4
                if len(cut) < len(ids):
                    spare.append((doc_id, start + len(cut) // 4, ids[len(cut) :], total))
        self.pieces = spare
        self.tokens = sum(len(p[2]) // 4 for p in spare)

    def flush(self) -> None:
        self.fill([self.capacity] * (self.tokens // self.capacity))

    def finish(self) -> None:
        self.flush()
        bits = range(self.tokens.bit_length() - 1, -1, -1)
        self.fill([1 << k for k in bits if self.tokens >> k & 1])

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, window_tokens: int = 1 << 20
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of the tokenizer's file on every machine. window_tokens
    bounds what a task holds; documents are never cut short by it. A sequence id is
    the number of the task's partition in the upper bits and a count below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        window = Window(capacity, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids, whole = batch.column("doc_id").to_pylist(), texts(batch)
            for at in range(0, len(whole), 256):
                for doc_id, ids in zip(doc_ids[at : at + 256], encode(whole[at : at + 256]), strict=True):
                    window.add(doc_id, ids + end)
                    if window.tokens >= window_tokens:
                        window.flush()
                if window.rows:
                    yield batched(NAMES, TYPES, list(zip(*window.take(), strict=True)))
        window.finish()
        if rows := window.take():
            yield batched(NAMES, TYPES, list(zip(*rows, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
