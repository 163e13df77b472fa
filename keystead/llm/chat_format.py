"""Operator 7, chat formatting of reply trees.

Messages name the message they answer. Leaves are messages nobody answers; paths
from every leaf up to its root are enumerated by self-joins that double their
reach: the pairs known up to a distance are joined with the ancestors at that
distance, so a path of n messages takes about log2(n) joins. Branches of a tree
are ranked by the mean score of their messages, and each chosen path
becomes one conversation in a template with turn marks:

    <|im_start|>role LF text <|im_end|> LF

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
text can hold a mark, and reading back restores it; a line feed in a role becomes ``\\n``.

Defined cases: null roles and texts are empty; a message whose parent is null or absent
is a root; messages that only lead round in a circle are on no path; messages
with equal tree and id must not occur (``turn_messages`` numbers rows, so repeated and tied rows are turns of
their own); a null conversation id is one conversation; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystead.llm.common import batched, materialise

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turns(turns: list[tuple[str, str]], learned: str) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans of the texts of the role that is learned, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def turn_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each answers the one before; ties go by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return numbered.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def branches(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, distance: every message on the path from each leaf to its root."""
    nodes = messages.select("tree", F.col("msg_id").alias("node"), "parent_id")
    parents = nodes.select("tree", F.col("node").alias("parent_id")).distinct()
    jumps = materialise(
        nodes.join(parents, ["tree", "parent_id"]).select("tree", "node", F.col("parent_id").alias("above")), "jumps"
    )
    roots = nodes.join(jumps, ["tree", "node"], "left_anti").select("tree", "node")
    answered = jumps.select("tree", F.col("above").alias("node")).distinct()
    leaves = nodes.join(answered, ["tree", "node"], "left_anti")
    paths = materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")), "paths")
    longest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < longest:
        further = paths.join(jumps, ["tree", "node"]).select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("distance") + reach).alias("distance")
        )
        further = materialise(further, "paths")
        if further.isEmpty():
            break
        paths = materialise(paths.unionByName(further), "paths")
        upper = jumps.select("tree", F.col("node").alias("above"), F.col("above").alias("higher"))
        jumps = materialise(jumps.join(upper, ["tree", "above"]).select("tree", "node", F.col("higher").alias("above")), "jumps")
        reach *= 2
    ended = paths.join(roots, ["tree", "node"]).select("tree", "leaf").distinct()
    return paths.join(ended, ["tree", "leaf"], "left_semi")


def format_trees(messages: DataFrame, top: int | None = None, learned: str = "assistant") -> DataFrame:
    """conv_id, leaf, rank, formatted, loss_spans of the ``top`` best branches of every tree (all by default).

    messages: conv_id, msg_id, parent_id, role, text, score. Ties in rank go to the smaller leaf.
    """
    keyed = messages.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    keyed = materialise(keyed.select("tree", "conv_id", "msg_id", "parent_id", "role", "text", "score"), "messages")
    on_path = branches(keyed.select("tree", "msg_id", "parent_id")).withColumnRenamed("node", "msg_id")
    scored = on_path.join(keyed.select("tree", "msg_id", "score"), ["tree", "msg_id"])
    ranked = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    ranked = ranked.select("tree", "leaf", F.row_number().over(order).alias("rank"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    turns = on_path.join(ranked, ["tree", "leaf"]).join(
        keyed.select("tree", "msg_id", "conv_id", "role", "text"), ["tree", "msg_id"]
    )
    text = F.struct((-F.col("distance")).alias("at"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    paths = turns.groupBy("tree", "leaf", "rank").agg(
        F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(text)).alias("turns")
    )
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, spans = [], []
            for turns in batch.column("turns").to_pylist():
                whole, masked = format_turns([(t["role"], t["text"]) for t in turns], learned)
                formatted.append(whole)
                spans.append([{"start": a, "end": b} for a, b in masked])
            names = ["conv_id", "leaf", "rank"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(span)]
            columns = [*(batch.column(name) for name in names), formatted, spans]
            yield batched([*names, "formatted", "loss_spans"], kinds, columns)

    return paths.select("conv_id", "leaf", "rank", "turns").mapInArrow(
        run,
        "conv_id long, leaf long, rank int, formatted string, loss_spans array<struct<start: long, end: long>>",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What reading back gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))
            for conv_id, whole, spans in zip(*columns, strict=True):
                turns = read_back(whole)
                loss = "".join(unescape(whole[s["start"] : s["end"]]) for s in spans)
                digest = sha("".join(f"{role}\n{text}\n" for role, text in turns))
                out.append((conv_id, len(turns), digest, len(loss), sha(loss), len(whole)))
            yield batched(names, kinds, list(zip(*out, strict=True)) or [[]] * 6)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
