"""Operator 5, benchmark decontamination by templates; DataFrame functions only.

Numbers, units after numbers and names (capitalised words inside a sentence)
become typed placeholders; other words are lower-cased letters. Windows of
template tokens of a benchmark item and of a document that are equal meet in a
hash join, so an item with other numbers or names is found as well. An item also
enters with its names as plain words, for documents that changed the case. Capitalised
words that open a text or sentence may be names or not, so items and documents
enter with them as words and as names; common opening words stay words.
For the documents and items that meet, slots are then compared: along a run of
matching windows every slot value of the item must stand for one value in the
document. A pair counts when the windows without such a contradiction cover at least
``coverage`` of the item, or when ``run_windows`` of them follow each other: 20 words in a row,
whatever the length of the item.

A text is read once: words that may be names keep a sign of their own, and the
second reading turns it into a slot. Tokens are hashed once, and a window is the
hash of their hashes. Only places whose first two tokens start some window of the
benchmark are hashed at all; a bitmap of fixed size tells most others at once,
and a place that strikes a wrong bit is left out by the join.

Items shorter than a window are matched as a whole, so windows have one length
more for each such length. Windows of which more than half are slots say
nothing as templates and match by their literal values only; an item that has
such windows enters once more with all its windows, so a copy of it is found.

Defined cases: null and empty texts and items match nothing. A document is an id
and a text, so rows that share an id, or have none, are judged each by its own
text; repeated rows are one document, and a pair of id and item is reported once.
Texts of any length are read whole; ties between readings go to the greater
coverage. Other columns are not read; empty tables give an empty result. Sizes: the distinct window hashes of the benchmark are
written first, so the planner knows their size; small ones are broadcast by
its own limit, others are joined by a shuffle of hashes.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import materialise

#: Signs that open a slot token; they are removed from texts first.
NUMBER, NAME, UNIT, FIRST = "\u0001", "\u0002", "\u0003", "\u0004"
UNITS = (
    "km|cm|mm|m|kg|g|mg|t|l|ml|s|ms|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|"
    "inch(?:es)?|meters?|metres?|kilometers?|grams?|kilograms?|pounds?|liters?|litres?|dollars?|euros?|cents?|percent"
)
NUMBERS = rf"(?=[0-9])([0-9]+(?:[.,:/][0-9]+)*)(?:\s*((?i:{UNITS}))(?!\p{{L}}))?"
#: A capitalised word after a lower-case letter, a digit or a comma. Patterns begin with their cheapest test, which most places fail.
NAMES = r"(?=\s)(?<=[\p{Ll}0-9,])(\s+)(\p{Lu}\p{Ll}+)(?!\p{L})"
#: Words that open sentences and are not read as names.
OPENERS = (
    "The|An|And|But|Or|If|In|On|At|For|From|To|Of|By|As|So|Then|When|While|What|Which|Who|Whose|Where|Why|How|There|"
    "This|That|These|Those|It|Its|He|She|They|We|You|His|Her|Their|Our|My|Your|Is|Are|Was|Were|Do|Does|Did|Can|Could|"
    "Will|Would|Should|May|Has|Have|Had|Each|Every|All|Some|Any|No|Not|After|Before|With|Without|During|Let|Find|"
    "Compute|Calculate|Suppose|Given|Please"
)
#: Any other capitalised word, after ``NAMES`` have got their sign.
FIRST_NAMES = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}0-9\x02])(?!(?:{OPENERS})(?!\p{{L}}))(\p{{Lu}}\p{{Ll}}+)(?!\p{{L}})"
#: Readings of names: as words, as slots inside a sentence, as slots everywhere.
WORDS, INSIDE, EVERYWHERE = 0, 1, 2
TOKENS = r"[\x02-\x04]?\p{L}+|\x01[0-9.,:/]+"
#: Bits of the map of window starts: 64 KB.
GATE_BITS = 1 << 19


def valued_tokens(text: Column, names: int, first: str = NAME) -> Column:
    """Words in lower case; numbers, names and units with the sign of their slot before them.

    first: the sign of names that only the reading EVERYWHERE sees.
    """
    text = F.coalesce(text, F.lit(""))
    out = F.when(text.rlike("[\x01-\x04]"), F.translate(text, NUMBER + NAME + UNIT + FIRST, "    ")).otherwise(text)
    if names >= INSIDE:
        out = F.regexp_replace(out, NAMES, f"$1 {NAME}$2 ")
    if names >= EVERYWHERE:
        out = F.regexp_replace(out, FIRST_NAMES, f" {first}$1 ")
    out = F.regexp_replace(out, NUMBERS, f" {NUMBER}$1 {UNIT}$2 ")
    return F.regexp_extract_all(F.lower(out), F.lit(TOKENS), F.lit(0))


def is_slot(token: Column) -> Column:
    return token < F.lit("\u0005")


def template_hashes(tokens: Column) -> Column:
    """Hashes of the tokens, those of slots without their values; a ``FIRST`` name is a word."""
    return F.transform(
        tokens,
        lambda t: F.when(
            is_slot(t),
            F.when(t < FIRST, F.xxhash64(F.left(t, F.lit(1)))).otherwise(F.xxhash64(F.substr(t, F.lit(2)))),
        ).otherwise(F.xxhash64(t)),
    )


def named_hashes(tokens: Column, hashes: Column) -> Column:
    """The hashes where ``FIRST`` names are slots too."""
    return F.transform(tokens, lambda t, i: F.when(t.startswith(FIRST), F.xxhash64(F.lit(NAME))).otherwise(F.get(hashes, i)))


def literal(tokens: Column) -> Column:
    """Tokens without the signs of slots: the same for every reading of names."""
    return F.transform(tokens, lambda token: F.when(is_slot(token), F.substr(token, F.lit(2))).otherwise(token))


def literal_hash(size: Column, values: Column) -> Column:
    return F.xxhash64(F.lit("literal"), size, values)


def heavy_windows(raw: Column, size: int) -> Column:
    """Position and literal hash of the windows of which more than half are slots, found from the places of slots."""
    least, last = size // 2 + 1, F.size(raw) - size
    places = F.filter(F.transform(raw, lambda token, i: F.when(is_slot(token), i)), lambda i: i.isNotNull())
    # windows that hold ``least`` slots from one slot on
    starts = F.transform(
        F.when(F.size(places) >= least, F.sequence(F.lit(0), F.size(places) - least)).otherwise(F.array().cast("array<int>")),
        lambda j: F.struct(
            F.greatest(F.lit(0), F.get(places, j + least - 1) - size + 1).alias("low"),
            F.least(F.get(places, j), last).alias("high"),
        ),
    )
    starts = F.filter(starts, lambda w: w["low"] <= w["high"])
    found = F.array_distinct(F.flatten(F.transform(starts, lambda w: F.sequence(w["low"], w["high"]))))
    return F.transform(
        found,
        lambda i: F.struct(i.alias("pos"), literal_hash(F.lit(size), literal(F.slice(raw, i + 1, size))).alias("hash")),
    )


def window_hash(hashes: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(size, F.slice(hashes, start + 1, size))


def windows(hashes: Column, size: Column) -> Column:
    """Position and hash of every window of ``size`` tokens, and the bit of its first two tokens."""
    last = F.size(hashes) - size
    found = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(i.alias("pos"), window_hash(hashes, i, size).alias("hash"), start_bit(hashes, i).alias("start")),
    )
    return F.when(last >= 0, found)


def start_bit(hashes: Column, at: Column) -> Column:
    """The bit of the map of window starts for the tokens at a place; null where only one token is left."""
    pair = F.get(hashes, at).bitwiseXOR(F.shiftleft(F.get(hashes, at + 1), 1))
    return pair.bitwiseAND(F.lit(GATE_BITS - 1))


def gate(index: DataFrame) -> Column:
    """The map of the starts of all windows of two and more tokens: whole numbers of 64 bits, as a constant."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("start").bitwiseAND(F.lit(63)).cast("int"))
    marked = index.where("size > 1").groupBy(F.shiftright("start", 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    words = [0] * (GATE_BITS // 64)
    for row in marked.collect():  # a row for every number at most
        words[row["at"]] = row["bits"]
    return F.from_json(F.lit(json.dumps(words)), "array<bigint>")


def likely_windows(found: DataFrame, sizes: list[int], starts: Column) -> DataFrame:
    """doc_id, digest, pos, hash: the windows, in both readings, whose first two tokens start a window of the benchmark.

    A row for every token until the map is asked; so the work on single tokens is compiled, which that inside functions
    on arrays is not.
    """

    def marked(hashes: Column) -> Column:
        bit = start_bit(hashes, F.col("pos"))
        word = F.get(starts, F.shiftright(bit, 6).cast("int"))
        return F.call_function("shiftright", word, bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def window(reading: str, size: int) -> Column:
        fits = F.col("pos") <= F.size(reading) - size
        fits = fits & F.col(f"starts {reading}") if size > 1 else fits
        return F.when(fits, window_hash(F.col(reading), F.col("pos"), F.lit(size)))

    readings = ["plain", "named"]
    # the outer form, as the other one puts a filter below that reads the texts once more
    places = found.select("doc_id", "digest", *readings, F.posexplode_outer("plain").alias("pos", "token")).where("pos IS NOT NULL")
    places = places.withColumns({f"starts {r}": F.coalesce(marked(F.col(r)), F.lit(False)) for r in readings})
    if min(sizes) > 1:
        places = places.where(F.col("starts plain") | F.col("starts named"))
    each = F.array(*[window(reading, size) for size in sizes for reading in readings])
    return places.select("doc_id", "digest", "pos", F.explode(each).alias("hash")).where("hash IS NOT NULL")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, variant, size, ipos, hash, start, slots (offset, value), heavy: the windows of every item, in all variants.

    Variants 0, 1 and 2 are the readings of names and leave out heavy windows, those of which more than half are slots.
    Items with heavy windows have all their windows in the variants 3, 4 and 5 as well, heavy ones by literal values.
    """
    forms = [
        benchmark.select("item_id", F.lit(variant).alias("variant"), valued_tokens(F.col("text"), variant).alias("raw"))
        for variant in (WORDS, INSIDE, EVERYWHERE)
    ]
    items = reduce(DataFrame.unionByName, forms).where(F.size("raw") > 0)
    items = items.withColumn("size", F.least(F.size("raw"), F.lit(size))).withColumn("tokens", template_hashes(F.col("raw")))
    items = items.select("item_id", "variant", "size", "raw", F.explode(windows(F.col("tokens"), F.col("size"))).alias("w"))
    items = items.withColumn("own", F.slice("raw", F.col("w.pos") + 1, F.col("size")))
    slots = F.filter(
        F.transform("own", lambda token, i: F.struct(i.alias("offset"), token.alias("value"))),
        lambda slot: is_slot(slot["value"]),
    )
    items = items.select("item_id", "variant", "size", "own", "w", slots.alias("slots"))
    items = items.withColumn("heavy", 2 * F.size("slots") > F.col("size"))
    kept = ["item_id", "variant", "size", F.col("w.pos").alias("ipos"), "w.hash", "w.start", "slots", "heavy"]
    light = items.where("not heavy").select(*kept)
    dense = items.where("heavy").select(F.col("item_id").alias("dense_id"), F.col("variant").alias("dense_variant")).distinct()
    whole = items.join(
        dense, F.col("item_id").eqNullSafe(F.col("dense_id")) & F.expr("variant = dense_variant"), "left_semi"
    ).withColumns({
        "variant": F.col("variant") + len(forms),
        "w": F.when(
            F.col("heavy"), F.struct(F.col("w.pos").alias("pos"), literal_hash(F.col("size"), literal(F.col("own"))).alias("hash"), F.col("w.start").alias("start"))
        ).otherwise(F.col("w")),
        "slots": F.when(F.col("heavy"), F.slice("slots", 1, 0)).otherwise(F.col("slots")),
    })
    return light.unionByName(whole.select(*kept))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, coverage: float = 0.3, run_windows: int = 13
) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, matched, item_windows, coverage, changed_slots."""
    best = F.max(F.struct("coverage", "matched", "item_windows", "changed_slots")).alias("best")
    found = held_items(docs, benchmark, size, coverage, run_windows).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.matched", "best.item_windows", "best.coverage", "best.changed_slots")


def text_digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def held_items(docs: DataFrame, benchmark: DataFrame, size: int, coverage: float, run_windows: int) -> DataFrame:
    """As ``contaminated``, for every id and text: with the column digest of the text."""
    index = materialise(item_windows(benchmark, size), "windows")
    hashes = materialise(index.select("hash").distinct(), "hashes")
    # at most ``size`` different numbers, with and without heavy windows
    kinds = [tuple(row) for row in index.select("size", "heavy").distinct().collect()]
    sizes, dense = sorted({n for n, heavy in kinds if not heavy}), sorted({n for n, heavy in kinds if heavy})
    texts = docs.select("doc_id", "text", text_digest().alias("digest"))
    starts = gate(index.where("not heavy"))
    found = texts.select("doc_id", "digest", valued_tokens(F.col("text"), EVERYWHERE, FIRST).alias("raw"))
    found = found.withColumn("plain", template_hashes(F.col("raw")))
    found = found.withColumn("named", named_hashes(F.col("raw"), F.col("plain")))
    hits = likely_windows(found, sizes or [size], starts)
    if dense:
        each = F.flatten(F.array(*[heavy_windows(F.col("raw"), n) for n in dense]))
        heavy = found.select("doc_id", "digest", F.explode(each).alias("w"))
        hits = hits.unionByName(heavy.select("doc_id", "digest", "w.pos", "w.hash"))
    hits = materialise(hits.join(hashes, "hash", "left_semi").distinct(), "hits")
    pairs = hits.join(index, "hash").withColumn("shift", F.col("pos") - F.col("ipos"))

    # the values of slots on both sides, for the documents that have such windows
    slotted = pairs.where(F.size("slots") > 0)
    wanted = slotted.select(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest")).distinct()
    own = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    whole = texts.join(wanted, own, "left_semi").select(
        F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest"), literal(valued_tokens(F.col("text"), INSIDE)).alias("raw")
    )
    sides = slotted.join(whole.distinct(), own).select(
        "doc_id",
        "digest",
        "item_id",
        "variant",
        "shift",
        F.explode(
            F.transform(
                "slots",
                lambda slot: F.struct(
                    slot["value"].alias("value"),
                    # of the same kind as the slot, whatever the document's reading of names
                    F.concat(F.left(slot["value"], F.lit(1)), F.get("raw", F.col("pos") + slot["offset"])).alias("other"),
                ),
            )
        ).alias("s"),
    )
    run = ["doc_id", "digest", "item_id", "variant", "shift"]
    values = sides.groupBy(*run, F.col("s.value").alias("value")).agg(
        F.min("s.other").alias("low"), F.max("s.other").alias("high")
    )
    values = materialise(values, "slots")
    broken = values.where("low <> high").groupBy(*run).agg(F.collect_set("value").alias("broken"))
    changed = values.where("low = high and low <> value").groupBy("doc_id", "digest", "item_id").agg(
        F.countDistinct("value").alias("changed_slots")
    )

    same_run = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in run]
    sound = pairs.alias("p").join(broken.alias("b"), same_run, "left").where(
        F.col("b.broken").isNull()
        | ~F.exists("p.slots", lambda slot: F.array_contains(F.col("b.broken"), slot["value"]))
    )
    runs = sound.groupBy(*(f"p.{c}" for c in run)).agg(F.sort_array(F.collect_set("p.ipos")).alias("places"))
    reach = F.sequence(F.lit(0), F.size("places") - run_windows)
    in_row = F.exists(reach, lambda i: F.get("places", i + run_windows - 1) - F.get("places", i) == run_windows - 1)
    in_row = F.when(F.size("places") >= run_windows, in_row).otherwise(F.lit(False))
    matched = runs.groupBy("doc_id", "digest", "item_id", "variant").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("matched"),
        F.max(in_row).alias("in_row"),
    )
    totals = index.groupBy("item_id", "variant").agg(F.countDistinct("ipos").alias("item_windows"))
    share = F.col("matched") / F.col("item_windows")
    best = (
        matched.alias("m")
        .join(totals.alias("t"), F.col("m.item_id").eqNullSafe(F.col("t.item_id")) & F.expr("m.variant = t.variant"))
        .where((share >= coverage) | F.col("in_row"))
        .groupBy("m.doc_id", "m.digest", "m.item_id")
        .agg(F.max(F.struct(share.alias("coverage"), "matched", "item_windows")).alias("best"))
    )
    return (
        best.alias("x")
        .join(
            changed.alias("c"),
            F.col("x.doc_id").eqNullSafe(F.col("c.doc_id")) & F.expr("x.digest = c.digest") & F.col("x.item_id").eqNullSafe(F.col("c.item_id")),
            "left",
        )
        .select(
            "x.doc_id",
            "x.digest",
            "x.item_id",
            "best.matched",
            "best.item_windows",
            "best.coverage",
            F.coalesce("c.changed_slots", F.lit(0)).cast("long").alias("changed_slots"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, coverage: float = 0.3, run_windows: int = 13
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = held_items(docs, benchmark, size, coverage, run_windows)
    bad = bad.select(F.col("doc_id").alias("bad id"), F.col("digest").alias("bad digest")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad id")) & (text_digest() == F.col("bad digest")), "left_anti")
