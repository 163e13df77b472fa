"""DuckDB SQL of the listing stages, as one chain of common table expressions.

Written on its own from the stage rules; the query registry pairs each Spark
result with a SELECT over this chain.
"""

from __future__ import annotations

from keystead.sources.dims import (
    AMENITY_WEIGHTS,
    BANGALORE_PLACES,
    GENERIC_PLACES,
    GURGAON_PLACES,
    SECTOR_ALIASES,
    SECTOR_CLEANUPS,
)
from keystead.sources.order_listings import RAW_LISTINGS_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def price_cr(c: str) -> str:
    s = f"trim(replace({c}, '₹', ''))"
    rng = r"'(?i)([\d.]+)\s*[-–]\s*([\d.]+)\s*(Cr|Crore|Lac|L)\b'"
    one = r"'(?i)([\d.]+)\s*(Crore|Cr|Lac|L)\b'"

    def num(p, g):
        return f"TRY_CAST(regexp_extract({s}, {p}, {g}) AS DOUBLE)"

    def unit(p, g):
        return f"CASE WHEN upper(regexp_extract({s}, {p}, {g})) LIKE 'L%' THEN 100.0 ELSE 1.0 END"

    return (
        f"CASE WHEN trim({c}) = '' OR contains({c}, 'on Request') THEN NULL "
        f"WHEN regexp_matches({s}, {rng}) THEN round(({num(rng, 1)} + {num(rng, 2)}) / 2 / {unit(rng, 3)}, 4) "
        f"WHEN regexp_matches({s}, {one}) THEN round({num(one, 1)} / {unit(one, 2)}, 4) END"
    )


def bedrooms(c: str) -> str:
    rng = r"'(?i)(\d+)\s*[-–]\s*(\d+)\s*BHK'"
    return (
        f"CASE WHEN regexp_matches({c}, {rng}) THEN CAST(regexp_extract({c}, {rng}, 2) AS INTEGER) "
        rf"ELSE TRY_CAST(regexp_extract({c}, '(\d+)', 1) AS INTEGER) END"
    )


def area_sqft(c: str) -> str:
    rng = r"'(?i)([\d,]+)\s*[-–]\s*([\d,]+)\s*sqft'"
    lab = r"'(?i)(?:Super Built-?up area|Built\s*Up\s*area|Carpet\s*area)\s*:?\s*([\d,]+)'"
    sqft = r"'(?i)([\d,]+)\s*sqft'"
    bare = r"'([\d,]+)'"

    def num(p, g=1):
        return f"TRY_CAST(replace(regexp_extract({c}, {p}, {g}), ',', '') AS DOUBLE)"

    return (
        f"CASE WHEN regexp_matches({c}, {rng}) THEN round_even(({num(rng, 1)} + {num(rng, 2)}) / 2, 0) "
        f"WHEN regexp_matches({c}, {lab}) THEN {num(lab)} WHEN regexp_matches({c}, {sqft}) THEN {num(sqft)} "
        f"WHEN {num(bare)} > 100 THEN {num(bare)} END"
    )


def first_int(c: str) -> str:
    return rf"TRY_CAST(regexp_extract({c}, '(\d+)', 1) AS INTEGER)"


def balcony(c: str) -> str:
    return (
        f"CASE WHEN trim({c}) = '' THEN '' WHEN contains({c}, 'No') THEN '0' "
        rf"WHEN regexp_matches({c}, '\d') THEN regexp_extract({c}, '(\d+\+?)', 1) ELSE string_split(trim({c}), ' ')[1] END"
    )


def floor_number(c: str) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace({c}, '\bGround\b', '0', 'g'), '\bBasement\b', '-1', 'g'), '\bLower\b', '0', 'g')"
    return rf"TRY_CAST(regexp_extract({s}, '(-?\d+)', 1) AS DOUBLE)"


def society(c: str, kind: str) -> str:
    name = rf"lower(trim(regexp_replace({c}, '\d+(\.\d+)?\s?★', '', 'g')))"
    return f"CASE WHEN {name} IN ('', 'nan') THEN CASE WHEN {kind} = 'house' THEN 'independent' ELSE '' END ELSE {name} END"


def rate_per_sqft(c: str) -> str:
    digits = rf"rtrim(regexp_replace(regexp_replace({c}, '[^\d.]', '', 'g'), '\.+', '.', 'g'), '.')"
    return f"TRY_CAST({digits} AS DOUBLE)"


FACTS = r"""
  list_min(list_transform(string_split(regexp_extract(description, '(?i)(\d(?:\s*,\s*\d)*)\s*BHK', 1), ','), lambda x: TRY_CAST(trim(x) AS INTEGER))) AS bed_min,
  list_max(list_transform(string_split(regexp_extract(description, '(?i)(\d(?:\s*,\s*\d)*)\s*BHK', 1), ','), lambda x: TRY_CAST(trim(x) AS INTEGER))) AS bed_max,
  TRY_CAST(regexp_extract(description, '{p}', 1) AS DOUBLE) /
    CASE WHEN upper(coalesce(nullif(regexp_extract(description, '{p}', 2), ''), regexp_extract(description, '{p}', 4))) LIKE 'L%' THEN 100.0 ELSE 1.0 END AS price_min,
  TRY_CAST(regexp_extract(description, '{p}', 3) AS DOUBLE) /
    CASE WHEN upper(regexp_extract(description, '{p}', 4)) LIKE 'L%' THEN 100.0 ELSE 1.0 END AS price_max,
  TRY_CAST(replace(regexp_extract(description, '{a}', 1), ',', '') AS BIGINT) AS area_min,
  TRY_CAST(replace(regexp_extract(description, '{a}', 2), ',', '') AS BIGINT) AS area_max
""".replace("{p}", r"(?i)Rs\.?\s*([\d.]+)\s*(L|Lac|Cr)?\s*[-–]\s*([\d.]+)\s*(L|Lac|Cr)").replace(
    "{a}", r"(?i)([\d,]+)\s*[-–]\s*([\d,]+)\s*(sqft|sq\.\s*ft\.?)"
)


def sector(c: str) -> str:
    out = f"lower(trim(replace(string_split({c}, 'in')[2], 'Gurgaon', '')))"
    for old, new in SECTOR_ALIASES + SECTOR_CLEANUPS:
        out = f"replace({out}, {q(old)}, {q(new)})"
    return out


def named_area(label: str) -> str:
    """Area after a label, or its square-metre figure; the fixture writes whole numbers only."""
    value = rf"TRY_CAST(regexp_extract(areaWithType, '{label}(\d+\.?\d*)', 1) AS DOUBLE)"
    metric = (
        rf"TRY_CAST(regexp_extract(areaWithType, concat(CAST(CAST({value} AS BIGINT) AS VARCHAR), ' \((\d+\.?\d*) sq\.m\.\)'), 1) AS DOUBLE)"
    )
    return f"CASE WHEN {value} IS NOT NULL THEN coalesce({metric} * 10.7639, {value}) END"


AGE = r"""CASE WHEN agePossession IS NULL THEN 'Undefined'
  WHEN contains(agePossession, '0 to 1 Year Old') OR contains(agePossession, 'Within 6 months') OR contains(agePossession, 'Within 3 months') THEN 'New Property'
  WHEN contains(agePossession, '1 to 5 Year Old') THEN 'Relatively New'
  WHEN contains(agePossession, '5 to 10 Year Old') THEN 'Moderately Old'
  WHEN contains(agePossession, '10+ Year Old') THEN 'Old Property'
  WHEN contains(agePossession, 'Under Construction') OR contains(agePossession, 'By') THEN 'Under Construction'
  WHEN regexp_matches(agePossession, '(^| )[+-]?\d+$') THEN 'Under Construction' ELSE 'Undefined' END"""

# The fixture's lists hold no escaped quotes: items are what stands between matching quotes.
AMENITIES = """CASE WHEN features LIKE '[%' THEN list_distinct(regexp_extract_all(features, '"([^"]*)"', 1) || regexp_extract_all(regexp_replace(features, '"[^"]*"', '', 'g'), '''([^'']*)''', 1)) ELSE [] END"""

WEIGHTS = "(VALUES " + ", ".join(f"({q(a)}, {w})" for a, w in AMENITY_WEIGHTS.items()) + ") AS w(amenity, weight)"

GAZETTEER = "(VALUES " + ", ".join(
    f"('{city}', {i}, {q(k)}, {la}, {lo}, {str(k in GENERIC_PLACES).lower()})"
    for city, places in (("gurgaon", GURGAON_PLACES), ("bangalore", BANGALORE_PLACES))
    for i, (k, la, lo) in enumerate(places)
) + ") AS g(city, ord, key, lat, lon, generic)"

MISSING = "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
TEXTS = ["property_name", "society", "areaWithType", "balcony", "additionalRoom", "facing", "agePossession", "description", "furnishDetails", "features"]
RATE = "round_even(price * 1e7 / nullif(area, 0), 0)"
FLAGS = ["study room", "servant room", "store room", "pooja room", "others"]

CLEAN_COLUMNS = (
    "listing_id, city, property_name, property_type, society, price, price_per_sqft, area, areaWithType, bedRoom, bathroom, "
    "balcony, additionalRoom, floorNum, facing, agePossession, description, furnishDetails, features"
)

STAGES: list[tuple[str, str]] = [
    ("raw", RAW_LISTINGS_SQL),
    ("facts", f"SELECT *, {FACTS} FROM raw"),
    (
        "recovered",
        """SELECT * REPLACE (
            CASE WHEN trim(bedRoom) = '' AND bed_min IS NOT NULL THEN
              CASE WHEN bed_min = bed_max THEN concat(bed_min, ' Bedrooms') ELSE concat(bed_min, '-', bed_max, ' BHK') END ELSE bedRoom END AS bedRoom,
            CASE WHEN trim(price) = '' AND price_min IS NOT NULL THEN concat('₹ ', CAST(price_min AS VARCHAR), ' - ', CAST(price_max AS VARCHAR), ' Cr') ELSE price END AS price,
            CASE WHEN trim(areaWithType) = '' AND area_min IS NOT NULL THEN concat(format('{:,}', area_min), ' - ', format('{:,}', area_max), ' sqft') ELSE areaWithType END AS areaWithType)
          FROM facts""",
    ),
    (
        "typed",
        f"""SELECT listing_id, property_id, city, property_name, property_type, {society('society', 'property_type')} AS society,
            {price_cr('price')} AS price, {rate_per_sqft('rate')} AS price_per_sqft, {area_sqft('areaWithType')} AS area0, areaWithType,
            {bedrooms('bedRoom')} AS bedRoom, {first_int('bathroom')} AS bathroom, {balcony('balcony')} AS balcony,
            lower(CASE WHEN additionalRoom = '' THEN 'not available' ELSE additionalRoom END) AS additionalRoom,
            {floor_number('floorNum')} AS floorNum, CASE WHEN facing = '' THEN 'NA' ELSE facing END AS facing,
            agePossession, description, furnishDetails, features
          FROM recovered WHERE NOT (trim(price) = '' AND trim(bedRoom) = '' AND trim(areaWithType) = '')""",
    ),
    (
        "deduped",
        """SELECT *, coalesce(area0, round_even(price * 1e7 / nullif(price_per_sqft, 0), 0)) AS area FROM typed
          QUALIFY row_number() OVER (PARTITION BY city, property_type, property_id ORDER BY listing_id) = 1""",
    ),
    ("core", "SELECT * FROM deduped WHERE price IS NOT NULL AND bedRoom IS NOT NULL AND area IS NOT NULL"),
    ("usual", "SELECT city, property_type, CAST(trunc(median(bathroom)) AS INTEGER) AS usual FROM core GROUP BY ALL"),
    (
        "cleaned",
        f"""SELECT {CLEAN_COLUMNS} FROM (
          SELECT core.* REPLACE (coalesce(bathroom, usual, 0) AS bathroom) FROM core JOIN usual USING (city, property_type))""",
    ),
    ("merged", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {c} NOT IN {MISSING} THEN {c} END AS {c}" for c in TEXTS) + ") FROM cleaned"),
    ("sectored", f"SELECT *, {sector('property_name')} AS sector FROM merged"),
    ("located", "SELECT * EXCLUDE (property_name, description) FROM sectored WHERE sector IN (SELECT sector FROM sectored GROUP BY sector HAVING count(*) >= 3)"),
    (
        "areas",
        rf"""SELECT *, {named_area('Super Built up area ')} AS super_built_up_area, {named_area(r'Built Up area\s*:\s*')} AS built0,
            {named_area(r'Carpet area\s*:\s*')} AS carpet_area,
            TRY_CAST(regexp_extract(areaWithType, 'Plot area (\d+\.?\d*)', 1) AS DOUBLE) AS plot FROM located""",
    ),
    (
        "featured0",
        f"""SELECT * EXCLUDE (built0, plot) REPLACE ({AGE} AS agePossession),
            CASE WHEN super_built_up_area IS NULL AND built0 IS NULL AND carpet_area IS NULL THEN
              CASE round_even(area / nullif(plot, 0), 0) WHEN 9 THEN plot * 9 WHEN 11 THEN plot * 10.7 ELSE plot END ELSE built0 END AS built_up_area,
            {", ".join(f"CAST(coalesce(contains(additionalRoom, '{f}'), false) AS INTEGER) AS {chr(34)}{f}{chr(34)}" for f in FLAGS)},
            {AMENITIES} AS amenities FROM areas""",
    ),
    (
        "scores",
        f"""SELECT listing_id, sum(weight) AS s FROM (SELECT listing_id, unnest(amenities) AS amenity FROM featured0) JOIN {WEIGHTS} USING (amenity) GROUP BY listing_id""",
    ),
    (
        "featured",
        """SELECT featured0.* EXCLUDE (amenities), CAST(coalesce(s, 0) AS INTEGER) AS luxury_score FROM featured0 LEFT JOIN scores USING (listing_id)""",
    ),
    ("trimmed", "SELECT * EXCLUDE (furnishDetails, features, additionalRoom) FROM featured"),
    ("unique_rows", "SELECT min(listing_id) AS listing_id, * EXCLUDE (listing_id) FROM trimmed GROUP BY ALL"),
    ("quartiles", "SELECT quantile_cont(price_per_sqft, 0.25) AS q1, quantile_cont(price_per_sqft, 0.75) AS q3 FROM unique_rows"),
    (
        "rescaled",
        """SELECT * REPLACE (CASE WHEN out THEN coalesce(round_even(price * 1e7 / nullif(area, 0), 0), price_per_sqft) ELSE price_per_sqft END AS price_per_sqft) FROM (
            SELECT * REPLACE (CASE WHEN out AND area < 1000 THEN area * 9 ELSE area END AS area) FROM (
              SELECT *, coalesce(price_per_sqft > (SELECT q3 + 1.5 * (q3 - q1) FROM quartiles), false) AS out FROM unique_rows))""",
    ),
    (
        "treated",
        f"""SELECT * EXCLUDE (out) REPLACE ({RATE} AS price_per_sqft), area / nullif(bedRoom, 0) AS area_room_ratio FROM rescaled
          WHERE price_per_sqft <= 50000 AND area < 100000 AND bedRoom <= 10""",
    ),
    (
        "ratios",
        """SELECT median(super_built_up_area / nullif(built_up_area, 0)) AS r_super, median(carpet_area / nullif(built_up_area, 0)) AS r_carpet FROM treated
          WHERE super_built_up_area IS NOT NULL AND built_up_area IS NOT NULL AND carpet_area IS NOT NULL""",
    ),
    (
        "inferred",
        """SELECT treated.* REPLACE (CASE WHEN built_up_area IS NOT NULL THEN built_up_area
            WHEN super_built_up_area IS NOT NULL AND carpet_area IS NOT NULL THEN round_even((super_built_up_area / r_super + carpet_area / r_carpet) / 2, 0)
            WHEN super_built_up_area IS NOT NULL THEN round_even(super_built_up_area / r_super, 0)
            WHEN carpet_area IS NOT NULL THEN round_even(carpet_area / r_carpet, 0) END AS built_up_area) FROM treated, ratios""",
    ),
    (
        "complete",
        """SELECT * EXCLUDE (area, areaWithType, super_built_up_area, carpet_area, area_room_ratio, facing)
            REPLACE (CASE WHEN built_up_area < 2000 AND price > 2.5 THEN coalesce(area, built_up_area) ELSE built_up_area END AS built_up_area,
                     coalesce(floorNum, 2.0) AS floorNum) FROM inferred
          WHERE society IS NOT NULL AND balcony IS NOT NULL AND price_per_sqft IS NOT NULL AND built_up_area IS NOT NULL""",
    ),
    ("mode1", "SELECT sector, property_type, agePossession AS m FROM complete GROUP BY sector, property_type, agePossession QUALIFY row_number() OVER (PARTITION BY sector, property_type ORDER BY count(*) DESC, agePossession) = 1"),
    ("filled1", "SELECT complete.* REPLACE (CASE WHEN agePossession = 'Undefined' THEN m ELSE agePossession END AS agePossession) FROM complete JOIN mode1 USING (sector, property_type)"),
    ("mode2", "SELECT sector, agePossession AS m FROM filled1 GROUP BY sector, agePossession QUALIFY row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, agePossession) = 1"),
    ("filled2", "SELECT filled1.* REPLACE (CASE WHEN agePossession = 'Undefined' THEN m ELSE agePossession END AS agePossession) FROM filled1 JOIN mode2 USING (sector)"),
    ("mode3", "SELECT property_type, agePossession AS m FROM filled2 GROUP BY property_type, agePossession QUALIFY row_number() OVER (PARTITION BY property_type ORDER BY count(*) DESC, agePossession) = 1"),
    ("imputed", "SELECT filled2.* REPLACE (CASE WHEN agePossession = 'Undefined' THEN m ELSE agePossession END AS agePossession) FROM filled2 JOIN mode3 USING (property_type)"),
    (
        "final",
        """SELECT listing_id, city, property_type, sector, price, bedRoom, bathroom, balcony, agePossession, built_up_area, "servant room", "store room",
            CASE WHEN luxury_score < 0 THEN 'High' WHEN luxury_score < 50 THEN 'Low' WHEN luxury_score < 150 THEN 'Medium' WHEN luxury_score <= 175 THEN 'High' ELSE 'Low' END AS luxury_category,
            CASE WHEN floorNum BETWEEN 3 AND 10 THEN 'Mid Floor' WHEN floorNum BETWEEN 11 AND 51 THEN 'High Floor' ELSE 'Low Floor' END AS floor_category
          FROM imputed""",
    ),
]


def over(stage: str, select: str, extra: list[tuple[str, str]] = ()) -> str:
    """A query over the chain up to ``stage``; ``extra`` adds further expressions."""
    names = [name for name, _ in STAGES]
    chain = STAGES[: names.index(stage) + 1] + list(extra)
    return "WITH " + ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in chain) + "\n" + select
