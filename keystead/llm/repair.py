"""Conversation repair: the cheapest edits that give turns of the form (s?(ua)+)?.

Edits of a row are Delete, Keep and Rerole (to user or assistant); an empty row
can be Inserted anywhere. Rows that are blank or repeat an earlier row must be
deleted; a row that breaks off may stay at an extra cost. The edits are found by
iterative-deepening A*: depth-first search in the order D, I, K, R under
increasing cost bounds. A table keeps for every failed state the cost that is
proven to lie beyond it, so the next bound does not enter it in vain. The first
path that is accepted is the cheapest, and the first of those in ASCII order.

Spark does the rest: repeats are found by a grouped minimum of narrow rows
(conv_id, role, digest, turn) and a join whose hot key adaptive execution
splits. One byte a row then goes to the search, conversation after conversation
in sorted partitions. The edits lead the texts of their conversation in a second
sorted pass, which streams: no conversation is ever held as a group, and of one
with a third of all rows a task holds one byte a row. Such a conversation is
searched in segments, last one first, each behind the exact costs of the next;
its texts are digested one after the other, as a digest of them all needs.

Null role and null text count as one space, a null turn comes first and a null
conv_id is a conversation of its own. Rows of one turn are ordered by role and
digest of their text; repeated rows lie beside each other and are duplicates of
the first. Of ties between edits the ASCII-least letters win. Texts of any
length are read whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import batched, materialise

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FREE, GONE, CUT = 0, 1, 2
INF = 1 << 60
#: States: nothing yet, after a system row, after user, after assistant.
TURN = (2, 2, 3, 2)
KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
ROLE = {2: "user", 3: "assistant"}
SPACE = r"\x20\x09-\x0D"
EMPTY = hashlib.sha256().hexdigest()


# ---- the search


#: Initials that may follow each other, as codes: system user, user assistant, assistant user.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def forced(codes: bytes) -> list[int]:
    """For every place, costs that the rows from there on cause in any solution.

    A row that must go costs its deletion, a truncated one at least as much, one of another role at least a new
    role. Of two free rows that may not meet, with only the first two kinds between them, one must change or a row
    must stand between; such pairs count as far as they share no row.
    """
    out = [0] * (len(codes) + 1)
    after, behind = -1, 0  # role of the next free row, and what is behind it if it is paired with a row before it
    for i in range(len(codes) - 1, -1, -1):
        initial, fault = codes[i] & 3, codes[i] >> 2
        if fault:
            out[i], behind = out[i + 1] + DELETE, behind + DELETE
        elif initial == 3:
            out[i], after = out[i + 1] + REROLE, -1
        else:
            paired = after >= 0 and (initial, after) not in LEGAL
            out[i] = max(out[i + 1], behind + REROLE) if paired else out[i + 1]
            after, behind = initial, out[i + 1]
    return out


def deepen(codes: bytes, start: int, goals: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    """Cost, edits and final state of the cheapest path from ``start`` over the rows ``codes``.

    goals: cost behind the last row for each final state. last: rows may be inserted behind the last row.
    """
    n, rest, least = len(codes), forced(codes), min(goals)
    low = [r + least for r in rest for _ in range(4)]  # proven cost from (place, state) to the end
    for q in range(4):
        low[4 * n + q] = goals[q] if goals[q] < INF or not last else least + INSERT
    bound = low[start]
    while True:
        # a frame: place, state, cost so far, letters tried, least cost seen beyond the bound, as seen from here
        frames, letters = [[0, start, 0, 0, INF]], []
        while frames:
            frame = frames[-1]
            i, q, g, tried, beyond = frame
            if i == n and goals[q] < INF and g + goals[q] <= bound:
                return g + goals[q], "".join(letters), q
            if tried == 4:
                frames.pop()
                at = 4 * i + q
                low[at] = max(low[at], min(beyond, goals[q]) if i == n else beyond)
                if frames:
                    frames[-1][4] = min(frames[-1][4], low[at] + g - frames[-1][2])
                    letters.pop()
                continue
            frame[3] += 1
            cost, then, to = -1, i + 1, q
            if tried == 1:
                if i < n or last:
                    cost, then, to = INSERT, i, TURN[q]
            elif i < n:
                initial, fault = codes[i] & 3, codes[i] >> 2
                extra = TRUNCATED if fault == CUT else 0
                if tried == 0:
                    cost = DELETE
                elif fault != GONE and tried == 2 and KEEP[q][initial] >= 0:
                    cost, to = extra, KEEP[q][initial]
                elif fault != GONE and tried == 3:
                    cost, to = REROLE + extra, TURN[q]
            if cost < 0:
                continue
            need = cost + low[4 * then + to]
            if g + need > bound:
                frame[4] = min(beyond, need)
            else:
                frames.append([then, to, g + cost, 0, INF])
                letters.append("DIKR"[tried])
        bound = low[start]


#: Cost behind the last row: nothing left, or an answer at the end.
ACCEPT = (0, INF, INF, 0)


def cheapest(codes: bytes, segment: int = 64) -> tuple[int, str]:
    """Cost and edits of a conversation. segment: rows searched at a time in conversations of more than four such."""
    if len(codes) <= 4 * segment:
        return deepen(codes, 0, ACCEPT, True)[:2]
    goals, tables = ACCEPT, []
    for at in range((len(codes) - 1) // segment * segment, -1, -segment):
        last = at + segment >= len(codes)
        found = [deepen(codes[at : at + segment], q, goals, last) for q in range(4 if at else 1)]
        goals = tuple(cost for cost, _, _ in found)
        tables.append(found)
    audit, state = [], 0
    for found in reversed(tables):
        _, letters, state = found[state]
        audit.append(letters)
    return goals[0], "".join(audit)


# ---- rows


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, with nulls replaced."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    clean = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"))
    return clean.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _place(turn: Column) -> Column:
    """A turn as something that can be compared; null comes first."""
    return F.struct(turn.isNotNull().alias("given"), turn.alias("turn"))


def marked(rows: DataFrame) -> DataFrame:
    """Narrow rows: conv_id, turn, role, digest, initial, blank, truncated, and whether an earlier turn said the same."""
    narrow = keyed(rows).select(
        "conv_id", "turn", "role", "digest",
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"),
    )
    narrow = materialise(narrow, "narrow")
    said = narrow.groupBy("conv_id", "role", "digest").agg(F.min(_place(F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("n"))
    said = materialise(said.where("n > 1").drop("n"), "said-again")
    same = [narrow[c].eqNullSafe(said[c]) for c in ("conv_id", "role", "digest")]
    joined = narrow.join(said, same[0] & same[1] & same[2], "left")
    earlier = F.coalesce(said["first"] < _place(narrow["turn"]), F.lit(False))
    return joined.select(*[narrow[c] for c in narrow.columns], earlier.alias("repeated"))


AUDIT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults and the cheapest edits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, out = None, []
        known: dict[bytes, tuple[int, str]] = {}  # most conversations are short and look alike
        for batch in batches:
            if len(known) > 50_000:
                known.clear()
            for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if conversation is None or row[0] != conversation.id:
                    if conversation:
                        out.append(conversation.result(known))
                    conversation = Conversation(row[0])
                conversation.add(*row[1:])
            if len(out) >= 1000:
                yield _audit_batch(out)
                out = []
        yield _audit_batch(out + ([conversation.result(known)] if conversation else []))

    columns = ["conv_id", "turn", "role", "digest", "blank", "truncated", "repeated"]
    ordered = marked(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return ordered.select(*columns).mapInArrow(search, AUDIT)


def _audit_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in AUDIT.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return batched(names, [pa.int64()] * (len(names) - 1) + [pa.string()], [list(c) for c in columns])


class Conversation:
    """What is counted of one conversation while its rows pass in order."""

    PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}

    def __init__(self, conv_id: int | None) -> None:
        self.id, self.codes, self.before = conv_id, bytearray(), None
        self.turns = self.least = self.most = self.last_turn = None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, digest, blank, truncated, repeated) -> None:
        row = (turn, role, digest)
        if turn is not None and (self.turns is None or turn != self.last_turn):
            self.least = turn if self.turns is None else self.least
            self.turns, self.most, self.last_turn = (self.turns or 0) + 1, turn, turn
        duplicate = not blank and (repeated or row == self.before)
        cut = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        if self.before is not None and (self.before[1][:1], role[:1]) not in self.PAIRS:
            self.illegal += 1
        fault = GONE if blank or duplicate else CUT if cut else FREE
        self.codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * fault)
        self.before = row

    def result(self, known: dict[bytes, tuple[int, str]]) -> tuple:
        """The counts, cost and edits. known: edits of short conversations seen before."""
        gaps = 0 if self.turns is None else self.most - self.least + 1 - self.turns
        codes = bytes(self.codes)
        edits = known.get(codes) or cheapest(codes)
        if len(codes) <= 16:
            known[codes] = edits
        return (self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *edits)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired messages: conv_id, place from 0, the edit that made it (K, R or I), role, text.

    edits: conv_id, audit of every conversation. Rows of a conversation lie in one partition, in order.
    """

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, audit, at, state, place = None, "", 0, 0, 0
        out: list[tuple] = []

        def step(letter: str, role: str, text: str) -> None:
            nonlocal state, place
            if letter == "D":
                return
            to = KEEP[state][{"s": 0, "u": 1, "a": 2}[role[:1]]] if letter == "K" else TURN[state]
            out.append((conv_id, place, letter, role if letter == "K" else ROLE[to], "" if letter == "I" else text))
            state, place = to, place + 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                step("I", "", "")
                at += 1

        def passed() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            out.clear()
            return batched([f.split()[0] for f in REPAIRED.split(", ")], [pa.int64()] * 2 + [pa.string()] * 3, columns)

        for batch in batches:
            names = ("head", "conv_id", "audit", "role", "text")
            for head, conversation, letters, role, text in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                if head:
                    inserts()
                    conv_id, audit, at, state, place = conversation, letters, 0, 0, 0
                else:
                    inserts()
                    step(audit[at], role, text)
                    at += 1
            yield passed()
        inserts()
        yield passed()

    none = F.lit(None).cast("string")
    heads = edits.select(F.lit(True).alias("head"), "conv_id", "audit", none.cast("long").alias("turn"), none.alias("role"), none.alias("text"), none.cast("binary").alias("digest"))
    texts = keyed(rows).select(F.lit(False).alias("head"), "conv_id", none.alias("audit"), F.col("turn").cast("long"), "role", "text", "digest")
    together = heads.unionByName(texts).repartition("conv_id")
    ordered = together.sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "digest")
    return ordered.select("head", "conv_id", "audit", "role", "text").mapInArrow(edit, REPAIRED)


def digests(messages: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``repaired``: of all ``role:text``, joined by line breaks; read as they stream by."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, state, out = None, None, []
        for batch in batches:
            for conversation, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
                if place == 0:
                    if state:
                        out.append((conv_id, state.hexdigest()))
                    conv_id, state = conversation, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield batched(["conv_id", "repaired_sha256"], [pa.int64(), pa.string()], [list(c) for c in zip(*out, strict=True)])
                out = []
        if state:
            yield batched(["conv_id", "repaired_sha256"], [pa.int64(), pa.string()], [[conv_id], [state.hexdigest()]])

    return messages.mapInArrow(fold, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, cost and letters of the cheapest edits, digest of the repaired messages."""
    found = materialise(audits(rows), "audits")
    hashed = materialise(digests(repaired(rows, found.select("conv_id", "audit"))), "repaired-digests")
    joined = found.join(hashed, found["conv_id"].eqNullSafe(hashed["conv_id"]), "left")
    return joined.select(*[found[c] for c in found.columns], F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after faults that a hash of conversation and turn decides: of twenty parts one each
    is dropped, emptied, cut of its full stops, repeated, and made a user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    hit = rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return hit.drop("copy")


def repair_of_all(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``repair`` with a row for every conv_id in ``ids``; those without rows have no fault and no edit."""
    found = repair(rows)
    ids = ids.select("conv_id").distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(found[c], F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        ids["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")
    )
