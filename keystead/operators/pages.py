"""Listing fields from a table of stored web pages.

Fetching is not part of this: search pages and detail pages are rows of one
table (page_id, url, html), and a detail page is found by its url.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystead.functions.text import strip
from keystead.operators.outline import choose, first, with_elements
from keystead.operators.recover import recover
from keystead.operators.rows import first_of_computed
from keystead.schemas import HOUSE_RENAMES, LAND_TEXTS, RAW_TEXTS
from keystead.sources.tables import unseen
from keystead.storage import materialise

# Phrases and status codes of a refused page.
BLOCK_PHRASES = [
    "ACCESS DENIED", "CAPTCHA", "ROBOT", "CHROME-ERROR", "NETERROR",
    "ERR_NAME_NOT_RESOLVED", "ERR_CONNECTION", "ERR_TIMED_OUT",
]
BLOCK_STATUS = [403, 429, 503]

# Element ids of the detail page, by listing field.
DETAIL_IDS = {
    "price": "pdPrice2",
    "area": "srp_tuple_price_per_unit_area",
    "areaWithType": "factArea",
    "bedRoom": "bedRoomNum",
    "bathroom": "bathroomNum",
    "balcony": "balconyNum",
    "additionalRoom": "additionalRooms",
    "address": "address",
    "floorNum": "floorNumLabel",
    "facing": "facingLabel",
    "agePossession": "agePossessionLbl",
    "description": "description",
    "page_property_id": "Prop_Id",
}
# The card field that stands in where a detail page has none.
CARD_FALLBACKS = {
    "price": "card_price",
    "area": "card_psqft",
    "areaWithType": "card_area",
    "agePossession": "card_possess",
    "description": "card_desc",
}
# Classes and ids of the other blocks.
SEARCH_BLOCK = ("data-label", "SEARCH")
CARD_SECTION = ("data-hydration-on-demand", "true")
CARD_CLASSES = {
    "society": "tupleNew__locationName",
    "card_psqft": "tupleNew__perSqftWrap",
    "card_possess": "tupleNew__possessionBy",
}
HEADING, UNIT_TITLE, PRICE_WRAP = "tupleNew__propertyHeading", "tupleNew__propType", "tupleNew__priceValWrap"
CARD_AREA, CARD_TEXT, PROJECT_HEADING = "tupleNew__area1Type", "tupleNew__descText", "PseudoTupleRevamp__heading"
NEARBY, NEARBY_ITEM = "NearByLocation__tagWrap", "NearByLocation__infoText"
FURNISHING, FEATURES, RATING = "FurnishDetails", "features", "ratingByFeature__circleWrap"
RATING_PATH = r"(^|>)div(\.[^>.]+)*\.review__rightSide(\.[^>.]+)*>div[^>]*>ul[^>]*>li[^>]*>div[^>]*>"


def is_blocked(html: Column, status: Column | None = None) -> Column:
    """The page is a refusal, told from its text or its status code (H8)."""
    phrase = reduce(lambda a, b: a | b, [F.upper(html).contains(p) for p in BLOCK_PHRASES])
    return phrase if status is None else phrase | F.coalesce(status.isin(BLOCK_STATUS), F.lit(False))


def text_of(element: Column) -> Column:
    """Trimmed text of an element, ``''`` if there is none (H1)."""
    return strip(F.coalesce(element["text"], F.lit("")))


def items_of(elements: Column, container: Column, **item) -> Column:
    """Trimmed texts of the items within a container, empty without one (H2)."""
    texts = F.transform(choose(elements, inside=container, **item), text_of)
    return F.when(container.isNotNull(), texts).otherwise(F.array().cast("array<string>"))


def page_fields(pages: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """First text per field; ``spec`` maps field names to ``choose`` conditions (H1)."""
    wanted = [
        c.get("tag") or (f"#{c['id']}" if "id" in c else f".{c['cls']}") for c in spec.values()
    ]
    parsed = with_elements(pages, wanted)
    fields = [text_of(first(choose(F.col("elements"), **c))).alias(name) for name, c in spec.items()]
    return parsed.select("page_id", *fields)


def page_links(pages: DataFrame) -> DataFrame:
    """Every link in a page's navigation, one row each (H2, H5)."""
    parsed = with_elements(pages.select("page_id", "html"), ["a"], ["nav"])
    links = choose(F.col("elements"), tag="a", inside=first(choose(F.col("elements"), tag="nav")))
    return parsed.select("page_id", F.posexplode(links).alias("place", "e")).select(
        "page_id", "place", F.try_element_at("e.attrs", F.lit("href")).alias("href"), text_of(F.col("e")).alias("text")
    )


def with_search_block(pages: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Pages with their elements and ``search``, the block that holds the results.

    A page that does not name the block's attribute has none, so it is not parsed and has no elements.
    """
    may_hold = F.lower("html").contains(SEARCH_BLOCK[0])
    parsed = with_elements(pages.withColumn("html", F.when(may_hold, F.col("html"))), extra or [], ["div", "section"])
    return parsed.withColumn("search", first(choose(F.col("elements"), tag="div", attr=SEARCH_BLOCK)))


def page_rejects(pages: DataFrame) -> DataFrame:
    """Pages without a search block, and whether they look refused (H9)."""
    flagged = pages.withColumn("blocked", is_blocked(F.col("html")))
    return with_search_block(flagged.select("page_id", "url", "blocked", "html")).where(
        F.col("search").isNull()
    ).select("page_id", "url", "blocked")


def _title_case(text: Column) -> Column:
    """Upper case for every letter behind a non-letter, as Python's ``title``."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def cards(pages: DataFrame, site: str) -> DataFrame:
    """Listing cards of the search pages, one row per section with a link.

    A card with a heading link is a unit; otherwise its first link into
    ``site`` makes it a project. Ids lose their leading D and Z.
    """
    parsed = with_search_block(
        pages.select("page_id", "html"), ["a", "h2", "span", "p", *[f".{c}" for c in CARD_CLASSES.values()]]
    )
    sections = choose(F.col("elements"), tag="section", attr=CARD_SECTION, inside=F.col("search"))
    one = parsed.where(F.col("search").isNotNull()).select("page_id", F.explode(sections).alias("sec"), "elements")
    own = one.withColumn("e", choose(F.col("elements"), inside=F.col("sec"))).drop("elements")

    e = F.col("e")
    with_id = first(F.filter(e, lambda x: (x["tag"] == "div") & x["id"].isNotNull()))
    into_site = F.filter(
        e, lambda x: (x["tag"] == "a") & F.coalesce(F.try_element_at(x["attrs"], F.lit("href")).contains(site), F.lit(False))
    )
    heads = own.withColumns({
        "unit": first(choose(e, tag="a", cls=HEADING)),
        "project": first(into_site),
        "price_box": first(choose(e, tag="span", path=rf"(^|>)div(\.[^>.]+)*\.{PRICE_WRAP}[.>]")),
        "project_link": first(choose(e, tag="a", path=rf"\.{PROJECT_HEADING}[.>]")),
        "property_id": F.coalesce(F.regexp_replace(with_id["id"], "^[DZ]+", ""), F.lit("")),
    })
    is_unit = F.col("unit").isNotNull()
    link = F.coalesce(F.try_element_at("unit.attrs", F.lit("href")), F.try_element_at("project.attrs", F.lit("href")))
    texts = {name: text_of(first(choose(e, tag="div", cls=cls))) for name, cls in CARD_CLASSES.items()}
    fields = heads.withColumns({
        **texts,
        "link": link,
        "card_price": text_of(F.col("price_box")),
        "card_area": text_of(first(choose(e, tag="span", cls=CARD_AREA))),
        "card_desc": text_of(first(choose(e, tag="p", cls=CARD_TEXT))),
        "title": text_of(first(choose(e, tag="h2", cls=UNIT_TITLE))),
    }).where(F.col("link").isNotNull())
    society = F.when(is_unit, F.col("society")).otherwise(
        F.coalesce(F.nullif("society", F.lit("")), text_of(F.col("project_link")))
    )
    named = fields.withColumn("society", society)
    last_piece = _title_case(F.replace(F.element_at(F.split("link", "/"), -1), F.lit("-"), F.lit(" ")))
    unit_name = F.coalesce(F.nullif("title", F.lit("")), text_of(F.col("unit")))
    project_name = F.coalesce(F.nullif("society", F.lit("")), last_piece)
    return named.select(
        "page_id",
        F.col("sec.pos").alias("pos"),
        "property_id",
        F.when(is_unit, unit_name).otherwise(project_name).alias("property_name"),
        "link",
        "society",
        "card_price",
        "card_psqft",
        "card_area",
        "card_possess",
        "card_desc",
    )


def new_cards(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first card of every property id, in page and place order, without ids stored before."""
    if known is not None:
        found = unseen(found, known)
    ordered = found.withColumn("order", F.struct("page_id", "pos"))
    return first_of_computed(ordered, ["property_id"], "order").drop("order")


def details(pages: DataFrame) -> DataFrame:
    """Listing fields of every detail page, keyed by ``link``; of pages stored twice the first counts (H1-H4)."""
    wanted = [f"#{i}" for i in DETAIL_IDS.values()]
    wanted += [f".{NEARBY_ITEM}", f".{RATING}", "li"]
    blocks = [f".{NEARBY}", f"#{FURNISHING}", f"#{FEATURES}"]
    parsed = with_elements(pages.select("page_id", F.col("url").alias("link"), "html"), wanted, blocks)
    e = F.col("elements")
    fields = {name: text_of(first(choose(e, id=i))) for name, i in DETAIL_IDS.items()}
    nearby = items_of(e, first(choose(e, tag="div", cls=NEARBY)), tag="span", cls=NEARBY_ITEM)
    furnishing = items_of(e, first(choose(e, id=FURNISHING)), tag="li")
    feature_blocks = choose(e, id=FEATURES)
    step = parsed.withColumns({
        **fields,
        "nearbyLocations": nearby,
        "furnishDetails": furnishing,
        "rating": F.transform(choose(e, tag="div", cls=RATING, path=RATING_PATH), lambda x: x["text"]),
    })
    block = F.get(feature_blocks, F.when(F.size("furnishDetails") > 0, F.lit(1)).otherwise(F.lit(0)))
    found = step.withColumn("block", block).withColumn("features", items_of(e, F.col("block"), tag="li"))
    return first_of_computed(found.drop("elements", "block", "html"), ["link"], "page_id").drop("page_id")


def merge_cards(found: DataFrame, detail: DataFrame) -> DataFrame:
    """Cards with the fields of their detail page; a card without a page is left out.

    A field that the page lacks comes from the card, then from the description.
    """
    joined = found.join(detail, "link")
    filled = {
        field: F.coalesce(F.nullif(field, F.lit("")), F.col(card)) for field, card in CARD_FALLBACKS.items()
    }
    own_id = F.coalesce(F.nullif("page_property_id", F.lit("")), F.col("property_id"))
    texts = recover(joined.withColumns({**filled, "property_id": own_id}))
    lists = {c: F.to_json(c) for c in ("nearbyLocations", "furnishDetails", "features", "rating")}
    return texts.withColumns(lists).select(*RAW_TEXTS)


def house_shape(listings: DataFrame) -> DataFrame:
    """House columns: the rate and the number of floors."""
    return listings.withColumnsRenamed(HOUSE_RENAMES)


def land_shape(listings: DataFrame) -> DataFrame:
    """The 14 columns of a land listing."""
    renamed = listings.withColumnsRenamed({"floorNum": "floorNumAllowed", "agePossession": "possession"})
    return renamed.withColumn("noOfOpenSides", F.lit("")).select(*LAND_TEXTS)


KINDS = {"flats": None, "apartments": None, "houses": house_shape, "land": land_shape}


def listings_from_pages(pages: DataFrame, kind: str, site: str, known: DataFrame | None = None) -> DataFrame:
    """Raw listings of one kind from search and detail pages.

    Only pages that a card links to are parsed as detail pages; cards whose id
    is among ``known`` (a table with property_id) are left out before that.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    found = materialise(new_cards(cards(pages, site), known), "cards")
    linked = pages.join(found.select(F.col("link").alias("url")), "url", "left_semi")
    listings = merge_cards(found, details(linked))
    shape = KINDS[kind]
    return listings if shape is None else shape(listings)
