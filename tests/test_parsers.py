"""Golden cases of the text, place and feature functions."""

import random

import pytest
from pyspark.sql import functions as F

from keystead.functions import features as ft
from keystead.functions import labels as lb
from keystead.functions import place as pl
from keystead.functions import text as tx
from keystead.functions.numeric import half_even, round_exact

NBSP = " "

CASES = [
    (tx.price_to_cr, [
        ("1.7 Crore", 1.7), ("85 Lac", 0.85), ("₹85 Lac", 0.85), ("₹ 0.94 - 1.34 Cr", 1.14),
        ("Price on Request", None), ("94 L - 1.34 Cr", 0.94), ("59 – 99 lac", 0.79), ("1.2.3 Cr", None),
        (f"1.7{NBSP}Crore", 1.7), ("", None), (None, None), ("12 Lacs", None),
    ]),
    (tx.bedrooms, [("3 Bedrooms", 3), ("2-3 BHK", 3), ("1 Bedroom", 1), ("", None), (None, None)]),
    (tx.area_sqft, [
        ("1,164 - 1,758 sqft", 1461.0), ("1,114 sqft", 1114.0), ("Super Built-up area 1130(104.98 sq.m.)", 1130.0),
        ("Carpet area: 1250", 1250.0), ("Plot area 90", None), ("Plot area 101", 101.0), ("1 - 2 sqft", 2.0), ("", None),
    ]),
    (tx.first_int, [("4 Bathrooms", 4), ("none", None), (None, None)]),
    (tx.balcony, [("No Balcony", "0"), ("3+ Balconies", "3+"), ("2 Balconies", "2"), ("", ""), (None, ""), ("many here", "many")]),
    (tx.floor_number, [("Ground of 4", 0.0), ("Basement", -1.0), ("Lower Ground of 3", 0.0), ("12 of 60 Floors", 12.0), ("", None), ("Grounded 5", 5.0)]),
    (lambda c: tx.society(c, F.lit("flat")), [("Green Park 4.2 ★", "green park"), ("nan", ""), (None, ""), ("4★ Home", "home")]),
    (lambda c: tx.society(c, F.lit("house")), [("", "independent"), ("Villa", "villa")]),
    (tx.rate_per_sqft, [("₹ 8,500/sq.ft.", 8500.0), ("5000..", 5000.0), ("abc", None), ("", None), (None, None)]),
    (tx.missing_to_null, [("NA", None), ("", None), ("nan", None), ("East", "East"), (" ", " ")]),
    (tx.facing_or_na, [("", "NA"), (None, "NA"), ("East", "East")]),
    (tx.additional_room, [("", "not available"), ("Study Room", "study room")]),
    (tx.is_blank, [("", True), (NBSP, True), (None, True), (" a", False)]),
    (pl.sector_text, [("3 BHK Flat in Sector 57, Gurgaon", "sector 57,"), ("no place", None), ("Flat in Binny, Bangalore", "b")]),
    (lambda c: pl.sector_text(c, True), [("3 BHK Flat in Sector 57, Gurgaon", "sector 57")]),
    (pl.apply_aliases, [
        ("dlf phase 1", "sector 26"), ("sushant lok phase 3", "sector 57"), ("new palam vihar", "sector 110"),
        ("sohna road", "sohna road road"), ("ashok vihar phase 2", "sector 3 phase 2"), ("mg road, bangalore", "sector 28, bangalore"), (None, None),
    ]),
    (pl.first_comma_piece, [("whitefield, bangalore", "whitefield"), ("x", "x")]),
    (pl.city_slug, [("Gurugram", "gurgaon"), ("BENGALURU", "bangalore"), ("Jaipur", "jaipur")]),
    (pl.city_of, [("hebbal, Bangalore", "bangalore"), ("sector 5", "gurgaon"), (None, "gurgaon")]),
    (lambda c: ft.named_area(c, ft.SUPER_BUILT_UP), [
        ("Super Built up area 1130 (104.98 sq.m.)", 104.98 * 10.7639), ("Super Built up area 1130.50 (104.98 sq.m.)", 1130.5),
        ("Super Built up area 420", 420.0), ("Built Up area: 3", None), (None, None),
    ]),
    (lambda c: ft.named_area(c, ft.BUILT_UP), [("Super Built up area 9 Built Up area: 380 (35 sq.m.)", 35 * 10.7639)]),
    (ft.age_bucket, [
        ("0 to 1 Year Old", "New Property"), ("Within 3 months", "New Property"), ("1 to 5 Year Old", "Relatively New"), ("5 to 10 Year Old", "Moderately Old"),
        ("10+ Year Old", "Old Property"), ("By 2027", "Under Construction"), ("Dec 2026", "Under Construction"), ("soon", "Undefined"), (None, "Undefined"),
    ]),
    (ft.list_literal, [("['A', 'B']", ["A", "B"]), ("[\"Children's Play Area\", 'C']", ["Children's Play Area", "C"]), ("[]", []), ("text", []), (None, [])]),
    (lambda c: ft.luxury_score(ft.list_literal(c)), [("['Swimming Pool', 'Spa', 'Park', 'Spa']", 25), ("['Unknown']", 0), (None, 0)]),
    (lambda c: ft.item_count(c, F.lit("Fan")), [("['2 Fan', 'No Sofa']", 2), ("['No Fan']", 0), ("Fan", 1), ("['1 Exhaust Fan']", 1), ("", 0), (None, 0)]),
    (ft.furnishing_items, [("['2 Fan', '1 Bed', 'No Sofa']", ["Fan", "Bed", "Sofa"])]),
    (lb.readable_feature, [("sector_57", "📍 57"), ("agePossession_new", "🕒 Age: new"), ("bedRoom", "bedRoom")]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden(apply, case):
    fn, pairs = CASES[case]
    assert apply(fn, [x for x, _ in pairs]) == [y for _, y in pairs]


def test_bands(apply):
    assert apply(ft.luxury_band, [49, 50, 150, 175, 176, -1], "int") == ["Low", "Medium", "High", "High", "Low", "High"]
    floors = [2.0, 2.5, 3.0, 11.0, 52.0, -1.0, None]
    assert apply(ft.floor_band, floors, "double") == ["Low Floor", "Low Floor", "Mid Floor", "High Floor", "Low Floor", "Low Floor", "Low Floor"]


def test_description(apply):
    text = "Check out 2,3 BHK apartments, Rs. 94 L - 1.34 Cr, ranging between 1,245 - 1,865 sqft"
    got = apply(tx.description_facts, [text, "Rs 1.23 - 2.19 Cr only", "", None])
    assert [tuple(x) for x in got[0]] == [(2, 3), (0.94, 1.34), (1245, 1865)]
    assert [tuple(x) for x in got[1]] == [(None, None), (1.23, 2.19), (None, None)]
    assert all(v is None for fact in got[2] + got[3] for v in (fact or ()))


def test_fix_scale(spark):
    df = spark.createDataFrame([(900.0, 100.0), (1100.0, 100.0), (500.0, 100.0), (5.0, 0.0), (None, 7.0)], "a double, b double")
    assert [r[0] for r in df.select(ft.fix_scale(F.col("a"), F.col("b"))).collect()] == [900.0, 1070.0, 100.0, 0.0, 7.0]


def test_rounding_is_pythons(apply):
    rng = random.Random(7)
    values = [rng.randrange(10**7) / 10**5 for _ in range(4000)] + [rng.random() * 10 for _ in range(1000)] + [0.59675, 2.675, -1.00005]
    assert apply(lambda c: round_exact(c, 4), values, "double") == [round(v, 4) for v in values]
    assert apply(lambda c: round_exact(c, 2), values, "double") == [round(v, 2) for v in values]
    assert apply(half_even, [0.5, 1.5, 2.5, -0.5], "double") == [0.0, 2.0, 2.0, 0.0]
