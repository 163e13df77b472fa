"""Listing fields from small search and detail pages."""

import json

import pytest

from keystead.operators import pages as pg

SEARCH = """<html><body><script>var x='<a href="http://site.example/no">';</script>
<div data-label="SEARCH">
 <section data-hydration-on-demand="true"><div id="DZ101"><a class="tupleNew__propertyHeading big" href="/d/101">Link <b>text</b></a>
  <h2 class="tupleNew__propType">3 BHK Flat in Sector 57, Gurgaon</h2><div class="tupleNew__locationName"> Green &amp; Co </div>
  <div class="x tupleNew__priceValWrap"><p><span>&#8377; 1.2 Cr</span><span>no</span></p></div><span class="tupleNew__area1Type">1,000 sqft</span>
  <div class="tupleNew__possessionBy">By 2027</div><div class="tupleNew__perSqftWrap">9,000</div><p class="tupleNew__descText">card text</p></div></section>
 <section data-hydration-on-demand="true"><div><a href="http://other.example/p">x</a><a href="http://site.example/my-new-project's">p</a>
  <div class="PseudoTupleRevamp__heading"><i><a> </a></i></div></div></section>
 <section data-hydration-on-demand="true"><p>no link</p></section>
 <section data-hydration-on-demand="true"><div id="101"><a class="tupleNew__propertyHeading" href="/d/again">again</a></div></section>
 <section><a class="tupleNew__propertyHeading" href="/d/plain">not a card</a></section>
</div><section data-hydration-on-demand="true"><a class="tupleNew__propertyHeading" href="/out">outside</a></section></body></html>"""
DETAIL = """<div id="description">Homes of 2,3 BHK, Rs. 94 L - 1.34 Cr, 1,245 - 1,865 sqft</div><span id="bathroomNum"> 2 Bathrooms </span>
<div class="NearByLocation__tagWrap"><span class="NearByLocation__infoText">Metro</span><p><span class="NearByLocation__infoText"> Mall</span></p></div>
<div class="NearByLocation__tagWrap"><span class="NearByLocation__infoText">second block</span></div>
<ul id="FurnishDetails"><li>2 Fan<li>No AC</ul><ul id="features"><li>first</li></ul><ul id="features"><li>Spa</li><li>Park</li></ul>
<div class="a review__rightSide"><div><ul><li><div><section><div class="ratingByFeature__circleWrap">4 / 5</div></section></div></li></ul></div></div>
<div class="ratingByFeature__circleWrap">elsewhere</div><i id="Prop_Id">R77</i>"""


@pytest.fixture
def table(spark):
    rows = [(1, "/list", SEARCH), (2, "/d/101", DETAIL), (3, "http://site.example/my-new-project's", "<p id=pdPrice2>2 Cr"), (4, "/blocked", "Please solve this Captcha")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_cards(table):
    got = {r["link"]: r for r in pg.cards(table, "site.example").collect()}
    assert set(got) == {"/d/101", "http://site.example/my-new-project's", "/d/again"}
    unit, project = got["/d/101"], got["http://site.example/my-new-project's"]
    assert (unit["property_id"], unit["property_name"], unit["society"]) == ("101", "3 BHK Flat in Sector 57, Gurgaon", "Green & Co")
    assert (unit["card_price"], unit["card_area"], unit["card_possess"], unit["card_psqft"], unit["card_desc"]) == ("₹ 1.2 Cr", "1,000 sqft", "By 2027", "9,000", "card text")
    assert (project["property_name"], project["society"], project["property_id"]) == ("My New Project'S", "", "")
    kept = {r["link"] for r in pg.new_cards(pg.cards(table, "site.example")).collect()}
    assert kept == {"/d/101", "http://site.example/my-new-project's"}


def test_listings(table):
    got = {r["link"]: r for r in pg.listings_from_pages(table, "flats", "site.example").collect()}
    assert set(got) == {"/d/101", "http://site.example/my-new-project's"}
    unit = got["/d/101"]
    assert (unit["price"], unit["bedRoom"], unit["areaWithType"], unit["bathroom"]) == ("₹ 1.2 Cr", "2-3 BHK", "1,000 sqft", "2 Bathrooms")
    assert (unit["property_id"], unit["agePossession"], unit["area"]) == ("R77", "By 2027", "9,000")
    lists = {c: json.loads(unit[c]) for c in ("nearbyLocations", "furnishDetails", "features", "rating")}
    assert lists == {"nearbyLocations": ["Metro", "Mall"], "furnishDetails": ["2 FanNo AC", "No AC"], "features": ["Spa", "Park"], "rating": ["4 / 5"]}
    assert got["http://site.example/my-new-project's"]["price"] == "2 Cr"


def test_kinds(table):
    house = pg.listings_from_pages(table, "houses", "site.example")
    assert {"rate", "noOfFloor"} <= set(house.columns) and "area" not in house.columns
    land = pg.listings_from_pages(table, "land", "site.example")
    assert len(land.columns) == 14 and {r["possession"] for r in land.collect()} == {"By 2027", ""}
    with pytest.raises(ValueError):
        pg.listings_from_pages(table, "castles", "site.example")


def test_rejects(table):
    got = {r["page_id"]: r["blocked"] for r in pg.page_rejects(table).collect()}
    assert got == {2: False, 3: False, 4: True}


def test_status(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ok", 200), ("ok", 429), ("a robot?", None)], "html string, status int")
    assert [r[0] for r in df.select(pg.is_blocked(F.col("html"), F.col("status"))).collect()] == [False, True, True]
