import pytest
from pyspark.sql import functions as F

from terrace.functions import rows as r
from terrace.operators import rows as ops


def one(spark, make, value):
    got = spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]
    return tuple(got) if hasattr(got, "asDict") else got


@pytest.fixture(scope="module")
def gaz(spark):
    return spark.createDataFrame([("Winter Valley", "VIC", 0.0, 0.0), ("Wyee", "NSW", 0.0, 0.0), ("Springfield", "QLD", 0.0, 0.0), ("Springfield", "NSW", 0.0, 0.0), ("Beaudesert", "QLD", 0.0, 0.0), ("Bingara", "NSW", 0.0, 0.0)], "suburb string, state string, lat double, lng double")


@pytest.mark.parametrize(
    "line,want",
    [
        ("LAND SIZE : 400 m2 HOUSE SIZE: 209.5 sqm", (209.5, 400.0)), ("312 m² and 165.5m2", (165.5, 312.0)), ("Lot 5, 450 sq.m", (None, 450.0)), ("184.7m2 31.8m2", (None, None)), ("land size 300 m2, 120 m2 alfresco", (None, 300.0)),
        ("", (None, None)), (None, (None, None)),
    ],
)
def test_sizes(spark, line, want):
    assert one(spark, r.sizes, line) == want


@pytest.mark.parametrize("line,want", [("Registration: Aug 2026, titled", "Aug 2026"), ("Titled now", "Titled"), ("due Q1 2027", "Q1 2027"), ("Sep-26", "Sep-26"), ("nothing", None), (None, None)])
def test_title_status(spark, line, want):
    assert one(spark, r.title_status, line) == want


@pytest.mark.parametrize("line,want", [("4 bed 2.5 bath 2 car", (4, 2, 2)), ("4\n2\n2", (4, 2, 2)), ("3\t2", (3, 2, None)), ("3\n2\n1 car", (3, 2, 1)), ("99\n4\n2", (4, 2, None)), ("4", (None, None, None)), (None, (None, None, None))])
def test_rooms(spark, line, want):
    assert one(spark, r.rooms, line) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("$300,000 $250,000 $550,000", (550000.0, 300000.0, 250000.0, 1.0)), ("$300,000 $250,000 $600,000", (600000.0, None, None, 0.4)), ("Land price $466,000 House price: $463,934", (466000.0, 466000.0, 463934.0, 1.0)),
        ("PACKAGE $ 929,934 and $466,000", (929934.0, None, None, 1.0)), ("$850,000 for both homes, at a rent of $1,330 pw", (850000.0, None, None, 0.6)), ("call us", (None, None, None, 1.0)), (None, (None, None, None, 1.0)),
        ("Land Price 466000 Build Price 463934", (929934.0, 466000.0, 463934.0, 1.0)),
    ],
)
def test_price_fields(spark, line, want):
    df = spark.createDataFrame([(line,)], "x string").select("x", r.stated_prices(F.col("x")).alias("s"))
    assert tuple(df.select(r.price_fields(F.col("x"), F.col("s")).alias("y")).first().y) == want


@pytest.mark.parametrize("line,want", [("Lot 5\n12 Smith Street Wyee, NSW 2259", ("Wyee", "NSW")), ("Mango Hill QLD", ("Mango Hill", "QLD")), ("Main Road VIC", (None, "VIC")), ("BEAUDESERT", (None, None)), (None, (None, None))])
def test_place_and_state(spark, line, want):
    assert one(spark, r.place_and_state, line) == want


@pytest.mark.parametrize(
    "line,lot,estate,want",
    [
        ("105 Almond Street, Denman $500,000", None, "Aberdeen", "105 Almond Street, Denman"), ("520 Stony Drive $650,000 STOCK LIST", None, "Alluvium", "520 Stony Drive, Alluvium"), ("Lot 444, Hillcrest $700,000", "444", None, "Lot 444, Hillcrest"),
        ("103 Samara Estate Fraser Rise Available Bristol 15 $600,000", None, "Samara", "Lot 103, Samara"), ("Available 12 300 200 4 2 2 $600,000 package", "82", "ʊ Aberdeen", "Lot 82, Aberdeen"), ("CC-0122 Available 1 2 3 4 $1", "CC-0122", None, "CC-0122"),
        ("Package from $650,000 enquire now", None, "Aberdeen", None), ("100 Park Royal Crescent, GALLERY STOCK LIST 2026", None, None, "100 Park Royal Crescent"), ("1123 COMPLETED HOME 444 sold", None, None, None), (None, None, None, None),
    ],
)
def test_address_label(spark, line, lot, estate, want):
    df = spark.createDataFrame([(line, lot, estate)], "x string, lot string, estate string")
    assert df.select(r.address_label(F.col("x"), F.col("lot"), F.col("estate")).alias("y")).first().y == want


@pytest.mark.parametrize(
    "banner,want",
    [
        ("CREATION HOMES NSW STOCK LIST", "Creation Homes"), ("Agent Stock List 167 Ingleburn Road, Leppington", ""), ("New Homes", ""), ("Homes", ""), ("G-Developments 15-6-26", "G Developments"), ("Kemps Homes $500,000", ""), ("Price list", ""),
        ("Stage 1 building two", ""), ("", ""), (None, ""),
    ],
)
def test_builder_of_banner(spark, banner, want):
    assert one(spark, r.builder_of_banner, banner) == want


@pytest.mark.parametrize("label,want", [("vic/eastbury-wheelers-hill-pricelist.pdf", "Eastbury Wheelers Hill"), ("a/Pricelist2026.xlsx", ""), ("a/1101438-16S-PS-V1.pdf", ""), ("Eastbury", ""), ("a/Murcia 15-6-26 A.xlsx", "Murcia"), ("a/Stage 1.pdf", ""), (None, "")])
def test_project_of_file(spark, label, want):
    assert one(spark, r.project_of_file, label) == want


def test_first_links(spark):
    df = spark.sql("SELECT array(named_struct('anchor', 'Brochure', 'url', 'u1'), named_struct('anchor', 'flyer', 'url', 'u2'), named_struct('anchor', null, 'url', 'u3'), named_struct('anchor', 'x', 'url', '')) AS l")
    assert df.select(r.first_links(F.col("l")).alias("m")).first().m == {"brochure_url": "u1", "listing_url": "u3"}


def test_banner_localities(spark, gaz):
    rows = [(1, "Aberdeen - Winter Valley - VIC - House & Land", None), (2, "Harvest Hill | 1377 Hue Hue Road, Wyee", "NSW"), (3, "One Part Contracts", None), (4, "Bingara Gorge - Spec", None), (5, "wyee / springfield", "VIC"), (6, "Wyee / SPRINGFIELD", None), (7, None, None), (8, "wyee, Springfield", " nsw ")]
    df = spark.createDataFrame(rows, "id int, banner string, st string")
    got = {x.id: x.locality for x in ops.banner_localities(df, gaz, "id", "banner", F.col("st")).collect()}
    assert got == {1: "Winter Valley", 2: "Wyee", 6: "Springfield", 8: "Springfield"}


def test_to_listings(spark, gaz):
    rows = [
        (1, "Lot 82 4 bed 2 bath 2 car 350 m2 180 m2 $300,000 $250,000 $550,000 titled", "Aberdeen - Winter Valley - VIC"), (2, "Land $714,900", "Aberdeen"), (3, "$1,300,000 $1,250,000 $1,250,000 $1,200,000 $1,100,000 of all", "x"),
        (4, "no price here", "x"), (5, "BEAUDESERT\n105 Almond Street, Denman\n$500,000", None), (6, None, None), (7, "", ""),
    ]
    df = spark.createDataFrame(rows, "id int, line string, above string").withColumn("price", F.lit("clashes"))
    got = {x.id: x.asDict() for x in ops.to_listings(df, gaz, "id", "line", "above").collect()}
    assert sorted(got) == [1, 5]
    assert {k: got[1][k] for k in ("price", "land_price", "bedrooms", "land_size_sqm", "house_size_sqm", "suburb", "lot_address", "lot_number", "title_status", "extraction_confidence")} == {
        "price": 550000.0, "land_price": 300000.0, "bedrooms": 4, "land_size_sqm": 350.0, "house_size_sqm": 180.0, "suburb": "Winter Valley", "lot_address": "Lot 82, Aberdeen", "lot_number": "82", "title_status": "titled",
        "extraction_confidence": 0.98,
    }
    assert (got[5]["suburb"], got[5]["lot_address"], got[5]["extraction_confidence"], got[5]["estate_context"]) == ("Beaudesert", "105 Almond Street, Denman", 0.62, "")
    assert ops.to_listings(df.limit(0), gaz, "id", "line", "above").count() == 0
