"""A raw listing table derived from the order tables.

Used where no scraped files are at hand: one listing per order, with texts in
all the formats that real listings show, blanks and repeated ids included.
The query is plain SQL, so that any engine can run it over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystead.storage import spread

RAW_LISTINGS_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, c_nationkey AS nk, n_regionkey AS rk,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS lac
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT k AS listing_id,
  concat('P', CAST(k - CASE WHEN k % 50 = 1 THEN 1 ELSE 0 END AS STRING)) AS property_id,
  CASE WHEN rk % 2 = 0 THEN 'gurgaon' ELSE 'bangalore' END AS city,
  CASE WHEN k % 4 = 0 THEN 'house' ELSE 'flat' END AS property_type,
  CASE WHEN rk % 2 = 0 THEN concat(CAST(1 + k % 5 AS STRING), ' BHK Flat in ',
              CASE ck % 8 WHEN 0 THEN 'DLF Phase 1' WHEN 1 THEN 'Palam Vihar' WHEN 2 THEN 'Sohna Road'
                ELSE concat('Sector ', CAST(1 + ck % 114 AS STRING)) END, ' Gurgaon')
       ELSE concat(CAST(1 + k % 5 AS STRING), ' BHK Flat in ',
              CASE ck % 5 WHEN 0 THEN 'Whitefield' WHEN 1 THEN 'Hebbal' WHEN 2 THEN 'Soukya Road, Whitefield'
                ELSE concat('Block ', CAST(nk AS STRING)) END, ', Bangalore') END AS property_name,
  CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'Green Park 4.2 ★' ELSE concat('Society ', CAST(k % 40 AS STRING)) END AS society,
  CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(lac AS STRING), ' Lac')
     WHEN 2 THEN concat('₹ ', CAST(lac AS STRING), ' - ', CAST(lac + 20 AS STRING), ' Lac')
     WHEN 3 THEN concat('₹', CAST(1 + lac % 9 AS STRING), '.', CAST(lac % 10 AS STRING), ' Crore')
     WHEN 4 THEN 'Price on Request'
     ELSE concat(CAST(1 + lac % 9 AS STRING), ' Cr') END AS price,
  CASE WHEN k % 8 = 0 THEN '' ELSE concat('₹ ', CAST(3 + k % 60 AS STRING), ',', CAST(100 + k % 900 AS STRING), '/sq.ft.') END AS rate,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(1 + k % 12 AS STRING), ' Bedrooms')
     ELSE concat(CAST(1 + k % 3 AS STRING), '-', CAST(3 + k % 3 AS STRING), ' BHK') END AS bedRoom,
  CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN concat('1,', CAST(100 + lac % 800 AS STRING), ' - 2,', CAST(100 + lac % 800 AS STRING), ' sqft')
     WHEN 2 THEN concat('Super Built up area ', CAST(400 + lac * 7 AS STRING), ' (', CAST(40 + lac AS STRING), ' sq.m.)')
     WHEN 3 THEN concat('Carpet area: ', CAST(350 + lac * 5 AS STRING))
     WHEN 4 THEN concat('Super Built up area ', CAST(420 + lac * 7 AS STRING), ' Built Up area: ', CAST(380 + lac * 6 AS STRING),
                        ' Carpet area: ', CAST(350 + lac * 5 AS STRING))
     WHEN 5 THEN concat('Plot area ', CAST(90 + lac AS STRING))
     ELSE concat(CAST(300 + lac * 4 AS STRING), ' sqft') END AS areaWithType,
  CASE k % 9 WHEN 0 THEN '' ELSE concat(CAST(1 + k % 4 AS STRING), ' Bathrooms') END AS bathroom,
  CASE k % 6 WHEN 0 THEN 'No Balcony' WHEN 1 THEN '3+ Balconies' WHEN 2 THEN '' ELSE concat(CAST(k % 4 AS STRING), ' Balconies') END AS balcony,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'Servant Room' WHEN 2 THEN 'Study Room,Store Room' WHEN 3 THEN 'Pooja Room,Others'
     ELSE 'Servant Room,Store Room' END AS additionalRoom,
  CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN 'Ground of 4 Floors' WHEN 2 THEN 'Basement' WHEN 3 THEN 'Lower Ground of 3'
     ELSE concat(CAST(k % 60 AS STRING), ' of 60 Floors') END AS floorNum,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'East' ELSE 'North-West' END AS facing,
  CASE k % 8 WHEN 0 THEN '0 to 1 Year Old' WHEN 1 THEN '1 to 5 Year Old' WHEN 2 THEN '5 to 10 Year Old' WHEN 3 THEN '10+ Year Old'
     WHEN 4 THEN 'Under Construction' WHEN 5 THEN 'By 2027' WHEN 6 THEN 'Dec 2026' ELSE '' END AS agePossession,
  replace(CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '[^2 Fan^, ^1 Bed^, ^No Sofa^]' WHEN 2 THEN '[^3 Fan^, ^Modular Kitchen^, ^1 AC^]'
     ELSE '[^No AC^, ^1 Fan^]' END, '^', chr(39)) AS furnishDetails,
  replace(CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN '[^Swimming Pool^, ^Spa^, ^Park^, ^Spa^]' WHEN 2 THEN '["Children^s Play Area", ^Golf Course^]'
     WHEN 3 THEN '[]' ELSE '[^ATM^, ^Unknown Thing^, ^Club House^, ^Library^, ^Sauna^, ^Jacuzzi^, ^Golf Course^, ^Spa^]' END, '^', chr(39)) AS features,
  CASE WHEN k % 13 = 0 THEN '' ELSE concat('2,', CAST(3 + k % 3 AS STRING), ' BHK apartments, Rs. ', CAST(40 + lac % 50 AS STRING), ' L - ',
       CAST(1 + lac % 4 AS STRING), '.5 Cr, ranging between 1,2', CAST(10 + lac % 80 AS STRING), ' - 1,8', CAST(10 + lac % 80 AS STRING), ' sqft') END AS description
FROM base
"""

#: Listings are many times the size of the order they come from, and parsing them is bound by the CPU.
ORDERS_PER_TASK = 250_000
EMPTY_TEXTS = ["link", "address", "nearbyLocations", "rating"]


def raw_listings(spark: SparkSession, folder: str) -> DataFrame:
    """The listing table over ``orders``, ``customer`` and ``nation`` in ``folder``."""
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("orders", "customer", "nation")}
    return raw_listings_of(**tables)


def raw_listings_of(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    orders = spread(orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", ORDERS_PER_TASK)
    raw = orders.sparkSession.sql(
        RAW_LISTINGS_SQL.replace("FROM orders JOIN customer", "FROM {orders} orders JOIN {customer} customer")
        .replace("JOIN nation", "JOIN {nation} nation"),
        orders=orders, customer=customer, nation=nation,
    )
    return raw.withColumns({c: F.lit("") for c in EMPTY_TEXTS})
