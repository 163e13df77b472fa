"""The tiers of the place lookup."""

from keystead.operators.geo import add_coords, geo_lookup, sector_cities
from keystead.sources.dims import gazetteer


def test_tiers(spark):
    places = [
        ("Whitefield", "bangalore", (12.9698, 77.75)),  # exact
        ("whitefield, bangalore", "bangalore", (12.9698, 77.75)),  # raw name is a key
        ("k.r. puram", "bangalore", (13.0067, 77.6953)),  # only the raw name is a key
        ("soukya road, whitefield, bangalore", "bangalore", (12.997, 77.756)),  # longest key inside
        ("sector 114", "gurgaon", (28.4567, 77.0162)),  # sector 11 inside
        ("koram", "bangalore", (12.9352, 77.6245)),  # inside a key
        ("nowhere at all", "bangalore", (12.9716, 77.5946)),  # city centre
        ("nowhere at all", "gurgaon", (28.4595, 77.0266)),
        ("nowhere at all", "pune", (28.4595, 77.0266)),
        ("central bangalore", None, (12.9716, 77.5946)),  # city told from the name
        ("??", "gurgaon", (28.4595, 77.0266)),
        ("", "gurgaon", (None, None)),
        (None, "gurgaon", (None, None)),
    ]
    df = spark.createDataFrame([(s, c) for s, c, _ in places], "sector string, city string")
    got = {(r["sector"], r["city"]): (r["lat"], r["lon"]) for r in geo_lookup(df, gazetteer(spark)).collect()}
    assert got == {(s, c): at for s, c, at in places}


def test_matches_brute_force(spark):
    known = [tuple(r) for r in gazetteer(spark).orderBy("city", "ord").collect()]
    names = [f"{a} {b}".strip() for a in ("old", "hsr layout 2", "jp nagar", "sector 3", "road", "nagar") for b in ("", "cross", "sector 82a", "whitefield")]

    def lookup(name, city):
        keys = [r for r in known if r[0] == city]
        specific = [r for r in keys if not r[5]]
        for tier in (
            [r for r in keys if r[2] == name],
            sorted((r for r in specific if r[2] in name), key=lambda r: -len(r[2])),
            [r for r in specific if name in r[2]],
            [r for r in keys if r[6]],
        ):
            if tier:
                return tier[0][3], tier[0][4]

    pairs = [(n, c) for n in names for c in ("gurgaon", "bangalore")]
    df = spark.createDataFrame(pairs, "sector string, city string")
    got = {(r["sector"], r["city"]): (r["lat"], r["lon"]) for r in geo_lookup(df, gazetteer(spark)).collect()}
    assert got == {p: lookup(*p) for p in pairs}


def test_add_coords_keeps_rows(spark):
    df = spark.createDataFrame([(1, "hebbal"), (2, None), (3, "hebbal")], "id int, sector string")
    rows = {r["id"]: r["lat"] for r in add_coords(df.selectExpr("*", "'bangalore' city"), gazetteer(spark)).collect()}
    assert rows == {1: 13.0359, 2: None, 3: 13.0359}


def test_sector_cities(spark):
    df = spark.createDataFrame([("a", "bangalore"), ("a", "gurgaon"), ("b", "gurgaon"), ("x, bangalore", "gurgaon")], "sector string, city string")
    assert {tuple(r) for r in sector_cities(df).collect()} == {("a", "bangalore"), ("b", "gurgaon"), ("x, bangalore", "bangalore")}
