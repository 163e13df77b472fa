"""Work in many short tasks, and shorter ways that give what the longer ones give."""

import random

from pyspark.sql import functions as F

from keystead.functions import features, text
from keystead.operators import outline, pages
from keystead.plans import prepare
from keystead.sources import order_listings
from keystead.sources.order_pages import order_pages
from keystead.storage import spread

TAGS = ['<div class="a">', "</div>", '<p id="x">', "</p>", "<br>", "<li>", "</li>", "t &amp; ", "&lt", '<span class="b  c">', "</span>", '<a href="q?a=1">', "</a>", "\n", '<ul id="">', "</ul>", "&#6"]
ODD = ["x<", "<script>", "</script>", '<a href="u&amp;v">', "<title>", "<IMG src=x>", "<!-- c -->", "<br/>", '</p x="y">', "<p id=x>", '<i id="1" id="2">', "<template>", "</template>"]


def orders(spark, folder, n):
    rows = spark.range(n, numPartitions=1).select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit(1000.5).alias("o_totalprice"))
    rows.write.parquet(f"{folder}/orders.parquet")
    return rows


def test_plain_outline_equals_the_parser():
    draw = random.Random(5)
    many = ["", "x", "a < b", "</p>", "<p>a</div>b</p><li>1<li>2"]
    many += ["".join(draw.choices(TAGS, k=draw.randrange(1, 25))) for _ in range(3000)]
    many += ["".join(draw.choices(TAGS + ODD, k=draw.randrange(1, 25))) for _ in range(3000)]
    with_text = frozenset(["li", "#x", ".c", "a", "br"])
    names = with_text | {"div", "i"}
    plain = outline._PlainOutline(names, with_text)
    for page in many:
        assert plain.elements(page) == outline._Outline(names, with_text).elements(page), page


def test_tags_remembered_are_bounded():
    plain = outline._PlainOutline(frozenset(["a"]), frozenset())
    for k in range(outline.KNOWN_TAGS + 10):
        assert plain.elements(f'<a id="{k}">')[0]["id"] == str(k)
    assert len(plain.known) <= outline.KNOWN_TAGS


def test_pages_of_one_file_are_made_in_many_tasks(spark, tmp_path):
    orders(spark, tmp_path, 40)
    table = order_pages(spark, str(tmp_path))
    # four kinds of pages, each in a piece for every core
    assert table.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert table.where("page_id % 4 = 0").count() == 40 and table.where("page_id % 4 = 1").count() == 32


def test_rows_of_a_task_do_not_grow_with_the_table(spark):
    table = spark.range(1000, numPartitions=16)
    assert spread(table, "id").rdd.getNumPartitions() == 16
    assert spread(table, "id", 20).rdd.getNumPartitions() == 50
    assert spread(table, "id", 500).rdd.getNumPartitions() == 16
    assert spread(table, "id", 20).distinct().count() == 1000


def test_pages_without_the_mark_of_a_search_block_are_rejected(spark):
    rows = [(1, "a", None), (2, "b", ""), (3, "c", '<div DATA-Label="SEARCH">'), (4, "d", '<div data-label="&#83;EARCH">'), (5, "e", "<p>data-label</p> a robot"), (6, "f", '<p data-label="SEARCH">')]
    got = pages.page_rejects(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.blocked for r in got.collect()} == {1: None, 2: False, 5: True, 6: False}


def test_listings_of_one_file_are_made_in_short_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order_listings, "ORDERS_PER_TASK", 10)
    customer = spark.range(9).select(F.col("id").alias("c_custkey"), (F.col("id") % 2).alias("c_nationkey"))
    nation = spark.range(2).select(F.col("id").alias("n_nationkey"), F.col("id").alias("n_regionkey"))
    orders(spark, tmp_path, 400)
    table = order_listings.raw_listings_of(spark.read.parquet(f"{tmp_path}/orders.parquet"), customer, nation)
    assert table.rdd.getNumPartitions() >= 40 and table.count() == 400


def test_texts_that_cannot_match_are_read_as_before(apply):
    assert apply(text.price_to_cr, ["₹ 1 – 2 Cr", "₹ 1 - 2 Lac", "5-6", "7 ſq 8 Cr", "", None]) == [1.5, 0.015, None, 8.0, None, None]
    assert apply(text.bedrooms, ["2 – 4 bhK", "2-4 BHK", "3 BHK", "-", None]) == [4, 4, 3, None, None]
    assert apply(text.area_sqft, ["1,000 – 2,000 ſqft", "1,000 - 2,001 sqft", "900 sqft", None]) == [1500.0, 1500.0, 900.0, None]
    assert apply(text.floor_number, ["Lower Ground of 3", "Basement", "Grounds 7", "no", None]) == [0.0, -1.0, 7.0, None, None]
    assert apply(text.rate_per_sqft, ["₹ 3,100/sq.ft.", "..5", "a1..2b", "٣", ""]) == [3100.0, 0.5, 1.2, None, None]
    assert apply(lambda c: features.named_area(c, features.CARPET), ["Carpet area: 35 (4 sq.m.)", "carpet area: 35", "Carpet area : 7", None]) == [4 * 10.7639, None, 7.0, None]
    assert apply(lambda c: features.named_area(c, r"(\d+) x"), ["12 x", "x", None]) == [12.0, None, None]


def test_frequent_sectors_are_counted_over_titles(spark):
    names = ["2 BHK Flat in Sector 1 Gurgaon", "3 BHK Flat in Sector 1 Gurgaon", "1 BHK Flat in Sector 1, Gurgaon", "Flat in Sector 1 Gurgaon", "no place", None]
    rows = [(k, name, "gurgaon") for k, name in enumerate([*names, names[2], names[3]])]
    df = spark.createDataFrame(rows, "listing_id long, property_name string, city string")
    got = prepare.locate(df.withColumns({c: F.lit("") for c in ("address", "description", "rating")}))
    wanted = prepare.with_sector(df).where("sector is not null").collect()
    size = {r.sector: sum(x.sector == r.sector for x in wanted) for r in wanted}
    assert {(r.listing_id, r.sector) for r in got.collect()} == {(r.listing_id, r.sector) for r in wanted if size[r.sector] >= 3}
    assert 0 < got.count() < 8
