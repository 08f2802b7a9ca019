"""Briefs, payloads and the tables that keep a run."""

from pyspark.sql import functions as F

from terrace.functions.values import variant_key
from terrace.operators import research
from terrace.operators.rows import judged_again


def test_briefs_survive_anything(spark):
    rows = [(1, '{"budget_max": "$1,2x", "bedrooms_min": -2.9, "car_spaces_min": "  ", "client_name": 0, "preferred_builders": [["a"], " b ", false], "state": null}'), (2, ""), (3, None), (4, '"text"'), (5, '{"budget_max": {"a": 1}, "primary_suburbs": "Wyee"}'), (6, '{"storeys_max": 99999999999}')]
    got = {r.id: r for r in research.parse_briefs(spark.createDataFrame(rows, "id int, brief string").withColumn("STATE", F.lit("x")), "brief").collect()}
    assert (got[1].budget_max, got[1].bedrooms_min, got[1].car_spaces_min, got[1].client_name, got[1].state, got[1].preferred_builders) == (0.0, -2, 0, "Unnamed Client", "QLD", ["b", "false"])
    empty = [got[i].asDict() | {"id": 0} for i in (2, 3, 4)]
    assert empty[0] == empty[1] == empty[2] and empty[0]["primary_suburbs"] == [] and empty[0]["storeys_max"] is None
    assert (got[5].budget_max, got[5].primary_suburbs, got[6].storeys_max) == (0.0, ["Wyee"], 99999999999)
    assert research.parse_briefs(spark.createDataFrame([], "id int, brief string"), "brief").count() == 0


def _run(spark, kept, rejected):
    briefs = research.parse_briefs(spark.createDataFrame([(1, '{"client_name": "Ann \\"A\\"", "budget_max": 800000, "primary_suburbs": ["Wyee"]}'), (2, None)], "record_id int, brief string"), "brief")
    candidates = spark.createDataFrame(kept, "record_id int, id int, lot_address string, suburb string, price double, score double, recommendation string")
    return briefs, candidates, spark.createDataFrame(rejected, "record_id int, id int, reason string")


def test_payload_of_a_record_without_candidates_and_with_nulls(spark):
    import json

    run = _run(spark, [(1, 7, None, None, None, 80.0, None), (1, 6, "Lot 6", "Wyee", 700000.0, 80.0, "Hold"), (1, 5, "Lot 5", "Wyee", 1.0, 9.0, "Hold"), (3, 1, "x", "y", 1.0, 1.0, "z")], [(1, 1, "r"), (1, 2, "r")])
    got = {r.record_id: json.loads(r.payload) for r in research.payloads(*run, 2, "now").collect()}
    assert set(got) == {1, 2}
    assert "1. Lot 6, Wyee - $700,000 (Score: 80.0/100 - Hold)\n2. , - ? (Score: 80.0/100 - )" in got[1]["internal_note"].replace("2. ,  -", "2. , -")
    assert got[1]["custom_fields_update"]["candidates_reviewed"] == 4 and got[1]["consultant_review_task"]["title"] == 'Review Property Research for Ann "A"'
    assert got[2]["custom_fields_update"]["top_property_match"] == research.NOBODY and "Shortlist:\nNone" in got[2]["internal_note"]


def test_saved_runs_replace_themselves_and_broken_ones_are_not_read(spark, tmp_path):
    path = str(tmp_path / "audit")
    briefs, kept, rejected = _run(spark, [(1, 7, "Lot 7", "Wyee", 5.0, 80.0, "Hold")], [(2, 3, "too dear")])
    records = research.run_records(briefs, kept, rejected)
    for run in ("0001", "0001", "0002"):
        research.save_run(path, run, records if run == "0001" else records.where("record_id = 2"), kept if run == "0001" else kept.limit(0), rejected)
    records.write.parquet(f"{path}/records/run=0003")  # broke off before its mark
    rows = sorted((r.record_id, r.suburb, r.shortlist_count, r.rejected_count, str(r.run)) for r in research.saved(spark, path, "records").collect())
    assert [(*r[:4], int(r[4])) for r in rows] == [(1, "Wyee", 1, 0, 1), (2, None, 0, 1, 2)]
    assert research.saved(spark, path, "candidates").count() == 1 and research.saved(spark, path, "rejections").count() == 1


def test_links_beside_rows(spark):
    rows = spark.createDataFrame([(1, 1, "10", "20"), (1, 2, "30", "300000000"), (1, 3, None, "5"), (2, 1, "10", "20"), (1, 4, "50", "40")], "p int, r int, top string, bottom string")
    links = spark.createDataFrame([(1, 5.0, 8.0, "b"), (1, 1.0, 22.0, "a"), (1, 1.0, 22.0, "a"), (1, 0.0, 22.1, "far"), (1, 9.0, 90.0, "z"), (1, 9.0, None, "n"), (3, 9.0, 15.0, "q")], "p int, x double, y double, uri string")
    got = {(r.p, r.r): r.links for r in research.links_in_band(rows, links, ["p"], "r").collect()}
    assert got == {(1, 1): ["a", "a", "b"], (1, 2): ["z"], (1, 3): [], (2, 1): [], (1, 4): []}


def test_stored_rows_judged_again(spark):
    wall = "$1,300,000 $1,250,000 $1,250,000 $1,200,000 $1,100,000"
    rows = [(None, ""), ("", ""), ("Lot Price Status Suburb", "a column header"), (wall, "no longer a listing"), (f"4 bed 2 bath {wall}", ""), (f"512 Harvest {wall}", ""), ("$714,900 land", "no longer a listing"), ("350 m2 $714,900", ""), ("no price at all", "no longer a listing")]
    got = judged_again(spark.createDataFrame(rows, "line string, want string").withColumn("reason", F.lit("old")), "line").collect()
    assert [(r.line, r.reason) for r in got] == [(r.line, r.want) for r in got]


def test_ends_of_cut_lines(spark):
    cases = {"lot 5 arklay avail": "lot 5 arklay", "lot 5 arklay av": "lot 5 arklay av", "lot 5 not": "lot 5", "lot 5 onh": "lot 5", "lot 5 on": "lot 5 on", "available": "", "lot 5 q": "lot 5", "lot 5 quart": "lot 5", "lot 5 quarts": "lot 5 quarts", "lot 5 qua 3, 20": "lot 5", "lot 5 sep-2": "lot 5", "lot 5 12/0": "lot 5", "lot 5 tit 9/": "lot 5 tit", "lot 5 q1 hold": "lot 5"}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", variant_key(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == cases
