"""Place names and cities, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystead.functions.text import strip
from keystead.sources.dims import CITY_ALIASES, SECTOR_ALIASES, SECTOR_CLEANUPS


def sector_text(property_name: Column, strip_trailing_comma: bool = False) -> Column:
    """The piece of the listing title between its first and second ``in``.

    The split is case-sensitive and also happens inside words. Only the word
    ``Gurgaon`` is taken out, so a comma before it stays unless
    ``strip_trailing_comma`` is set.
    """
    piece = F.get(F.split(property_name, "in"), F.lit(1))
    sector = F.lower(strip(F.replace(piece, F.lit("Gurgaon"), F.lit(""))))
    return F.rtrim(sector, F.lit(", ")) if strip_trailing_comma else sector


def first_comma_piece(c: Column) -> Column:
    """The place name before its first comma."""
    return strip(F.split_part(c, F.lit(","), F.lit(1)))


def apply_aliases(sector: Column, aliases: list[tuple[str, str]] | None = None) -> Column:
    """Rewrite sub-area names by literal replacements, in list order.

    Every replacement sees the result of the one before, so this is a fold over
    the list and not a lookup. It runs per row: a few microseconds, where a
    join on the distinct places would shuffle every row. Places that hold none
    of the names stay as they are and skip the fold.
    """
    pairs = SECTOR_ALIASES + SECTOR_CLEANUPS if aliases is None else aliases
    steps = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in pairs])
    rewritten = F.aggregate(steps, sector, lambda name, step: F.replace(name, step["old"], step["new"]))
    return F.when(sector.rlike(any_of([old for old, _ in pairs if old])), rewritten).otherwise(sector)


def any_of(names: list[str]) -> str:
    """A pattern that finds any of the names, gathered by their first letters so that most places of a text fail at once."""
    rest: dict[str, list[str]] = {}
    for name in names:
        rest.setdefault(name[0], []).append(re.escape(name[1:]))
    return "|".join(f"{re.escape(first)}(?:{'|'.join(tails)})" for first, tails in rest.items())


def city_slug(city: Column, aliases: dict[str, str] | None = None) -> Column:
    """Known city alias to its canonical name, any other name in lower case."""
    pairs = CITY_ALIASES if aliases is None else aliases
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    lowered = F.lower(city)
    return F.coalesce(F.try_element_at(table, lowered), lowered)


def city_of(sector: Column) -> Column:
    """City told from the place name."""
    known = F.coalesce(F.lower(sector).contains("bangalore"), F.lit(False))
    return F.when(known, F.lit("bangalore")).otherwise(F.lit("gurgaon"))


def normalised_place(c: Column) -> Column:
    """Lower case, everything but letters, digits and blanks turned into blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))
