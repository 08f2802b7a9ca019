import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terrace.operators import captures
from terrace.sources import files, tables
from terrace.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_positional_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"keys": ["id", "price"], "rows": [["1", 5], ["2", None]]}))
    assert rows(files.positional_json(spark, str(tmp_path / "a.json"), ["id", "price", "gone"]), "id", "price", "gone") == [("1", "5", None), ("2", None, None)]
    (tmp_path / "b.json").write_text(json.dumps([{"id": 7, "price": 8}]))
    assert rows(files.positional_json(spark, str(tmp_path / "b.json"), ["id", "price"]), "id", "price") == [("7", "8")]


def test_comparables_and_gazetteer(spark, tmp_path):
    (tmp_path / "comparables1.csv").write_text("Suburb,State,Bedrooms,Price,Land_sqm\nAustral,nsw,4,\"$750,000\",400\n,NSW,4,1,1\nDenman,NSW,x,0,1\n")
    assert rows(files.comparables(spark, str(tmp_path / "comparables*.csv")), "suburb", "state", "bedrooms", "price", "source") == [("Austral", "NSW", 4, 750000.0, None)]
    (tmp_path / "g.csv").write_text("suburb,state,lat,lng\nAustral,nsw,-33.9,150.8\nX,NSW,,1\n")
    assert rows(files.gazetteer(spark, str(tmp_path / "g.csv")), "suburb", "state", "lat") == [("Austral", "NSW", -33.9)]


def test_registry_stops_at_its_marker_and_reads_no_login(spark, tmp_path):
    (tmp_path / "r.csv").write_text('NAME,EMAIL,PHONE,BUILDER,STATES,CONTRACT,E AGENT,PORTAL,LOGIN,PASSWORD,NOTES\na,b,c,Acme,"VIC, nsw/QLD",YES,no,https://p.example,,,\na,,,Beta,,,yes,,,,\na,,,Gamma,,,,,,,"sends pdf, weekly"\nLinkedIn Link,,,x\nq,,,Delta,,,,,,,\n')
    reg = files.registry(spark, str(tmp_path / "r.csv"))
    assert not {"email", "password"} & set(reg.columns)
    assert rows(reg, "builder_name", "states", "stock_channel") == [("Acme", ["VIC", "NSW", "QLD"], "portal"), ("Beta", [], "e_agent"), ("Gamma", [], "email_pdf")]
    assert rows(files.builders_in_state(reg, "vic"), "builder_name") == [("Acme",), ("Beta",), ("Gamma",)]
    asked = spark.createDataFrame([("acme homes",), ("",), ("zzz",)], "name string")
    assert dict(rows(files.find_builder(reg, asked), "name", "builder_name")) == {"acme homes": "Acme", "": None, "zzz": None}


def test_vendor_sections(spark, tmp_path):
    (tmp_path / "v.csv").write_text("NAME,EMAIL,PHONE,BUILDER,STATE,CONTRACT,EA,LINK\na,,,Acme,vic,,yes,https://acme.example\nBUILDERS IN PERTH\nacme,m,p,https://perth.example,wa\nPerthCo,,,www.p.example,wa\nLinkedIn Link\nsomeone,,,\nBuilders from Agents\nAgentCo - north\nxy\n")
    got = rows(files.vendor_sections(spark, str(tmp_path / "v.csv")), "builder_name", "states", "website", "section", "is_on_e_agent")
    assert got == [("Acme", "VIC", "https://acme.example", "primary", True), ("AgentCo", "", "", "agents", False), ("PerthCo", "WA", "www.p.example", "perth", False)]


def _workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Lot</t></si><si><t>Price</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="6"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>12</v></c><c r="B2" s="1"><v>612000</v></c><c r="C2"><f>HYPERLINK("https://x.example/plan","plan")</f><v>plan</v></c></row></sheetData></worksheet>')


def test_drop_folder(spark, tmp_path):
    _workbook(tmp_path / "list.xlsx")
    (tmp_path / "list.csv").write_bytes("Lot;Price\n7;500 \n".encode("utf-8-sig"))
    (tmp_path / "page.csv").write_text("<html>")
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 no")
    (tmp_path / "comparables.csv").write_text("a,b")
    got = files.drop_folder(spark, str(tmp_path))
    assert dict(rows(got, "name", "kind")) == {"list.xlsx": "xlsx", "list.csv": "csv", "page.csv": "refused", "broken.xlsx": "xlsx"}
    r = files.stocklist_rows(got).withColumn("line", files.row_text(F.col("cells"), F.col("money")))
    assert rows(r, "row", "line") == [(0, "Lot Price"), (0, "Lot Price"), (1, "12 $612,000 plan"), (1, "7 500")]
    assert r.where(F.array_contains("links", "https://x.example/plan")).count() == 1


def test_drop_csv_invents_nothing(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Lot,Beds,TotalPrice\nLot 1,,\"$500,000\"\n,3,1\n")
    r = files.drop_csv(spark, str(tmp_path / "s.csv")).collect()
    assert len(r) == 1 and r[0].lot_address == "Lot 1" and r[0].bedrooms is None and r[0].price == 500000 and r[0].suburb is None


def test_versions_and_publish(spark, tmp_path):
    new = spark.createDataFrame([(1, 100.0), (2, 5.0)], "k int, price double")
    first = dict(rows(tables.upsert(spark, None, new, "k", {"price": captures.STATED}, {"price": "before"}, str(tmp_path / "v1")), "outcome", "count"))
    again = dict(rows(tables.upsert(spark, str(tmp_path / "v1"), new, "k", {"price": captures.STATED}, {"price": "before"}, str(tmp_path / "v2")), "outcome", "count"))
    assert first == {"new": 2} and again == {"unchanged": 2}
    big = spark.range(600).select("id", F.lit("fine").alias("notes"), F.lit("s").alias("secret_note"))
    assert tables.publish(big, {"id", "notes"}, str(tmp_path / "p"), None) == 600
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["id", "notes"]
    with pytest.raises(ValueError):
        tables.publish(big.withColumn("notes", F.lit("a@b.com")), {"id", "notes"}, str(tmp_path / "q"), None)
    assert tables.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "p")]).endswith("p")
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [str(tmp_path / "none")])
    with pytest.raises(ValueError):
        tables.add_columns(big, {"x": "array<int>"})
    tables.export_csv(big.limit(0), {"id": "Id", "notes": "Notes"}, [F.col("id")], str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["Id", "Notes"]


def test_stream_keeps_the_newest_whatever_the_order(spark, tmp_path):
    for n, data in enumerate([[(1, 10.0, 5), (2, 7.0, 1)], [(1, 11.0, 6), (1, 9.0, 2)]]):
        spark.createDataFrame(data, "k int, price double, seen int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = ingest.read_captures(spark, str(tmp_path / "in"), "k int, price double, seen int", 1)
    ingest.upsert_stream(s, str(tmp_path / "t"), "k", {"price": captures.STATED, "seen": captures.ALWAYS}, {"price": "before"}, ["seen"], str(tmp_path / "cp")).awaitTermination()
    assert rows(ingest.current(spark, str(tmp_path / "t"), "k", {"price": captures.STATED, "seen": captures.ALWAYS}, {"price": "before"}), "k", "price", "before") == [(1, 11.0, 10.0), (2, 7.0, None)]


def test_lookups_of_a_gazetteer(spark):
    from terrace.operators import places

    rows = [("Wyee", "NSW", 1.0, 2.0), ("WYEE ", "nsw", 0.5, 2.0), ("Denman", "NSW", 1.0, 1.0), ("denman", "QLD", 3.0, 3.0), (" ", "NSW", 1.0, 1.0), (None, "VIC", 1.0, 1.0)]
    said = places.lookups(spark.createDataFrame(rows, "suburb string, state string, lat double, lng double"))
    assert {(r.key, r.state): (r.lat, r.lng) for r in said["points"].collect()} == {("wyee", "NSW"): (0.5, 2.0), ("denman", "NSW"): (1.0, 1.0), ("denman", "QLD"): (3.0, 3.0)}
    assert {r.key: (r.states, r.only) for r in said["states"].collect()} == {"wyee": (["NSW"], "NSW"), "denman": (["NSW", "QLD"], None)}
    assert {r.key: r.name for r in said["names"].collect()} == {"wyee": "WYEE", "denman": "Denman"} and said["by_state"].where("state = 'NSW'").count() == 2


def test_a_long_registry_is_refused(spark, monkeypatch):
    import pytest

    from terrace.sources import files

    monkeypatch.setattr(files, "MAX_REGISTRY", 2)
    reg = spark.range(3).selectExpr("concat('Name ', id) AS builder_name", "id AS ord")
    asked = spark.createDataFrame([("name",), ("Name 1 Homes",), ("",), (None,), ("name",)], "name string")
    with pytest.raises(ValueError):
        files.find_builder(reg, asked)
    assert sorted(map(tuple, files.find_builder(reg.where("ord < 2"), asked).collect()), key=str) == sorted([("name", "Name 0"), ("Name 1 Homes", "Name 1"), ("", None), (None, None), ("name", "Name 0")], key=str)
