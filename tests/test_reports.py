import datetime

from pyspark.sql import functions as F

from terrace.operators import compare
from terrace.sources import files, mail

PACKAGE = "id long, builder string, realistic double, extras double, house_sqm double, land_sqm double, bedrooms int, bathrooms double, car_spaces int, total double, km double, advisories string, verification string"
PAIR = "a long, b long, client string"


def test_a_pair_in_words(spark):
    rows = [
        (1, "Avia", 500_000.0, 15_000.0, 200.0, 400.0, 4, 2.5, 2, 92.25, 3.0, "Soil; ;Title", "Pending"), (2, "Bolt", 612_345.5, None, 180.4, None, 3, 2.0, None, 80.0, None, None, "Verified"),
        (3, None, None, None, None, None, None, None, None, None, None, None, None), (4, "Avia", 500_000.0, 15_000.0, 200.0, 400.0, 4, 2.5, 2, 92.25, 3.5, "", "Verified"),
    ]
    pairs = spark.createDataFrame([(1, 2, "Kim"), (3, 3, None), (1, 4, ""), (1, 9, "x")], PAIR)
    got = {(r.a, r.b): r for r in compare.compare(spark.createDataFrame(rows, PACKAGE), pairs).collect()}
    assert set(got) == {(1, 2), (3, 3), (1, 4)}
    one = got[1, 2]
    assert one.a_ahead == ["$112,346 lower once completion items are allowed for", "20 m² more internal house area", "1 more bedroom", "0.5 more bathroom", "scores 92.2 against 80.0 on the brief"]
    assert one.b_ahead == ["hands over more complete — $15,000 less to arrange separately"]
    assert one.confirm_a == ["Soil", "Title", "Listing status is pending"] and one.confirm_b == []
    assert one.verdict.startswith("On the figures the sources state, Avia lands $112,346 lower once completion items are allowed for, and Avia scores higher against the brief (92.2 / 100). This compares") and "Kim’s" in one.verdict
    assert got[3, 3].verdict == compare.ALIKE and got[3, 3].a_ahead == [] and got[3, 3].confirm_a == []
    assert got[1, 4].a_ahead == ["0.5 km closer to the target suburb"] and "both score 92.2 / 100 against the brief" in got[1, 4].verdict and "the buyer’s" in got[1, 4].verdict and "lands" not in got[1, 4].verdict


def test_a_checklist_names_each_failure_once(spark):
    briefs = spark.createDataFrame([(1, "Kim", 5.0), (2, "", None), (3, "Lee", 9.0)], "brief long, client string, budget_max double")
    shortlist = spark.createDataFrame([(1, "Lot 1", "Pending", True, 1.0, 1.0), (1, None, "Pending", None, None, 1.0), (3, "Lot 3", "Unavailable", True, 1.0, None), (7, "Lot 7", "Unavailable", None, None, None)], "brief long, address string, verification string, approved boolean, realistic double, total double")
    got = sorted((r.brief, r["item"], r.failure) for r in compare.checklist(briefs, spark.createDataFrame([(1,), (1,), (3,)], "brief long"), shortlist).collect())
    assert [x[:2] for x in got] == [(1, 5), (1, 6), (2, 1), (2, 2), (3, 5), (3, 11)]
    assert got[0][2] == "QA Item 5 Failed: Property not stated is Pending Confirmation without explicit consultant waiver."
    assert compare.checklist(briefs.limit(0), briefs.limit(0).select("brief"), shortlist.limit(0)).count() == 0


MESSAGE = "id long, `from` string, subject string, attachments array<string>"


def test_senders_by_rule(spark):
    domains = spark.createDataFrame([("acme.example", "Acme", 1), ("acme.example", "Other", 2), ("my-bolt.example", "Bolt", 3)], "domain string, builder string, ord int")
    known = spark.createDataFrame([("Bird",), ("McMullan Bird",), (None,), (" ",)], "name string")
    m = [
        (1, "A <a@acme.example>", None, None), (2, "b@bolt.test", "Stocklist", ["x.csv"]), (3, "c@gmail.com", "Re: lots", ["McMullan Bird - Printable Stocklist.pdf"]), (4, "d@sub.gmail.com", "stock list", ["x.pdf"]),
        (5, "e@mcmullan.test", "price list", ["x.pdf"]), (6, None, "price list", ["x.pdf"]), (7, "f@acme.test", "hello", ["x.pdf"]), (8, "g@own.test", "price list", ["x.pdf"]), (9, "h@wilson.test", "price list", ["x.pdf"]),
    ]
    got = {r.id: (r.builder, r.rule) for r in mail.senders(spark.createDataFrame(m, MESSAGE), domains, known, own=("own.test",)).collect()}
    # leading letters w and dots of a domain go, so the last one loses its own
    assert got == {1: ("Acme", "domain"), 2: ("Bolt", "label"), 3: ("McMullan Bird", "mention"), 4: (None, None), 5: ("McMullan Bird", "sender"), 6: (None, None), 8: (None, None), 9: ("ilson.test", "sender")}
    assert mail.senders(spark.createDataFrame(m, MESSAGE).limit(0), domains, known).count() == 0


def test_priced_lines_of_bodies(spark):
    day = datetime.date(2026, 2, 1)
    m = spark.createDataFrame([(1, day, "none\nLot 5 $450,000\r\n$1,000,001 flat"), (2, day, None), (3, None, "Lot 5 $450,000"), (4, day - datetime.timedelta(9), "Lot 5 $450,000"), (5, day, "Lot 6 $450,000")], "id long, sent date, body string")
    got = mail.body_listings(m, F.lit(day), 950_000.0, m.where("id = 5")).select("id", "line_no", "price", "lot_address", "extraction_confidence").collect()
    assert [tuple(r) for r in got] == [(1, 1, 450_000.0, "Lot 5 $450,000", 0.6)]


def test_grids_keep_order_and_gaps(spark):
    bodies = spark.createDataFrame([(1, "C:2=B@9;C:1=A@1;D:q/2/x//0;D:p/1//1500/0;D:q/1//bad/0;D:z/3/y//0;"), (2, ""), (3, None), (4, "C:1=Rent $@1;D:p/1//-2500.4/0;")], "id long, body string")
    got = sorted((r.id, r.row_no, list(r.cells)) for r in files.grid_rows(bodies, r"C:(\d+)=([\w $]+)@(\d+);", r"D:(\w+)/(\d+)/(\w*)/([\w.-]*)/(\d+);").collect())
    assert got == [(1, 0, ["A", "B"]), (1, 1, ["", "x"]), (1, 2, ["1500", ""]), (1, 3, ["", ""]), (4, 0, ["Rent $"]), (4, 1, ["$-2,500"])]
