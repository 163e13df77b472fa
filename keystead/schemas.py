"""Column types of every stage."""

from __future__ import annotations

from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructType

STRING, INT, LONG, DOUBLE = StringType(), IntegerType(), LongType(), DoubleType()


def typed(columns: dict[str, DataType]) -> StructType:
    schema = StructType()
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


RAW_TEXTS = [
    "property_name", "link", "society", "price", "area", "areaWithType", "bedRoom", "bathroom",
    "balcony", "additionalRoom", "address", "floorNum", "facing", "agePossession",
    "nearbyLocations", "description", "furnishDetails", "features", "rating", "property_id",
]
HOUSE_RENAMES = {"area": "rate", "floorNum": "noOfFloor"}
LAND_TEXTS = [
    "property_name", "link", "society", "price", "areaWithType", "address", "floorNumAllowed",
    "noOfOpenSides", "possession", "nearbyLocations", "description", "features", "rating",
    "property_id",
]


def raw_schema(kind: str) -> StructType:
    """All-text schema of a raw file of flats, apartments, houses or land."""
    if kind == "land":
        names = LAND_TEXTS
    elif kind in ("house", "houses"):
        names = [HOUSE_RENAMES.get(c, c) for c in RAW_TEXTS]
    else:
        names = RAW_TEXTS
    return typed({c: STRING for c in names})


CLEAN = typed({
    "listing_id": LONG, "city": STRING, "property_name": STRING, "property_type": STRING, "society": STRING,
    "price": DOUBLE, "price_per_sqft": DOUBLE, "area": DOUBLE, "areaWithType": STRING, "bedRoom": INT,
    "bathroom": INT, "balcony": STRING, "additionalRoom": STRING, "address": STRING, "floorNum": DOUBLE,
    "facing": STRING, "agePossession": STRING, "nearbyLocations": STRING, "description": STRING,
    "furnishDetails": STRING, "features": STRING, "rating": STRING,
})

FINAL = typed({
    "listing_id": LONG, "city": STRING, "property_type": STRING, "sector": STRING, "price": DOUBLE,
    "bedRoom": INT, "bathroom": INT, "balcony": STRING, "agePossession": STRING, "built_up_area": DOUBLE,
    "servant room": INT, "store room": INT, "furnishing_type": INT, "luxury_category": STRING,
    "floor_category": STRING,
})
FINAL_COLUMNS = [c for c in FINAL.names if c != "listing_id"]
