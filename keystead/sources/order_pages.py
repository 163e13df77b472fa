"""Search and detail pages derived from the order tables, for jobs that start from stored pages.

One search page per order with a unit or a project card, most with a detail
page behind the link, some pages stored twice, some refused. Plain SQL that
other engines run over the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystead.storage import spread

#: Pages are many times the size of the order they come from, and parsing them is bound by the CPU.
ORDERS_PER_TASK = 100_000

ORDER_PAGES_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS STRING) AS ks, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) AS lac,
         CASE WHEN o_orderkey % 3 = 0 THEN concat('http://site.example/d/new-park-', CAST(o_orderkey AS STRING))
              ELSE concat('/d/', CAST(o_orderkey AS STRING)) END AS link
  FROM orders),
details AS (
  SELECT k, link, concat('<div id="description">', CASE WHEN k % 4 = 0 THEN '' ELSE concat('Homes no ', ks, ' to see') END, '</div><span id="bathroomNum"> ',
    CAST(1 + k % 4 AS STRING), ' Bathrooms </span><span id="pdPrice2">', CASE WHEN k % 7 = 0 THEN '' ELSE concat('₹ ', lac, ' Lac') END,
    '</span><div class="NearByLocation__tagWrap"><span class="NearByLocation__infoText">Metro ', CAST(k % 9 AS STRING),
    '</span><p><span class="NearByLocation__infoText"> Mall</span></p></div>',
    CASE WHEN k % 2 = 0 THEN concat('<ul id="FurnishDetails"><li>', CAST(k % 4 AS STRING), ' Fan</li><li>No AC</li></ul>') ELSE '' END,
    '<ul id="features"><li>Gate</li></ul><ul id="features"><li>Spa</li><li>Park</li></ul>',
    '<div class="a review__rightSide"><div><ul><li><div><section><div class="ratingByFeature__circleWrap">', CAST(1 + k % 5 AS STRING),
    ' / 5</div></section></div></li></ul></div></div>', CASE WHEN k % 3 = 1 THEN '' ELSE concat('<i id="Prop_Id">R', ks, '</i>') END) AS html
  FROM base WHERE k % 5 <> 0)
SELECT k * 4 AS page_id, concat('/s/', ks) AS url, concat('<html><body><div data-label="SEARCH"><section data-hydration-on-demand="true">',
    CASE WHEN k % 3 = 0 THEN concat('<div><a href="http://other.example/p">x</a><a href="', link,
      '">p</a><div class="PseudoTupleRevamp__heading"><i><a>', CASE WHEN k % 2 = 0 THEN ' ' ELSE concat('Park ', CAST(k % 7 AS STRING)) END, '</a></i></div></div>')
    ELSE concat('<div id="DZ', ks, '"><a class="tupleNew__propertyHeading big" href="', link, '">Link <b>text</b></a><h2 class="tupleNew__propType">',
      CAST(1 + k % 5 AS STRING), ' BHK Flat in Sector ', CAST(1 + k % 100 AS STRING), '</h2><div class="tupleNew__locationName"> Green &amp; Co ',
      CAST(k % 40 AS STRING), ' </div><div class="x tupleNew__priceValWrap"><span>', lac, ' Lac</span></div><span class="tupleNew__area1Type">',
      CAST(300 + k % 700 AS STRING), ' sqft</span><div class="tupleNew__possessionBy">By 2027</div><div class="tupleNew__perSqftWrap">',
      CAST(3000 + k % 900 AS STRING), '</div><p class="tupleNew__descText">card text</p></div>') END,
    '</section>', CASE WHEN k % 11 = 0 THEN '<section data-hydration-on-demand="true"><p>no link</p></section>' ELSE '' END, '</div></body></html>') AS html
FROM base
UNION ALL SELECT k * 4 + 1, link, html FROM details
UNION ALL SELECT k * 4 + 2, link, '<span id="pdPrice2">stored twice</span>' FROM details WHERE k % 10 = 1
UNION ALL SELECT k * 4 + 3, concat('/x/', ks), 'Please solve this Captcha' FROM base WHERE k % 25 = 0
"""


def order_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages (page_id, url, html) over ``orders`` in ``folder``."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_totalprice")
    orders = spread(orders, "o_orderkey", ORDERS_PER_TASK)
    return spark.sql(ORDER_PAGES_SQL.replace("FROM orders", "FROM {orders} orders"), orders=orders)
