"""Queries whose work has to grow with their input: what crowded cells, long lists and large keys made slow, fail or wrong."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.functions import links, listing, rows, text, values
from terrace.operators import audits, brochures, captures, ladder, names, pooled
from terrace.sources import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_comparables_are_ranked_once_a_cell(spark):
    rows = spark.range(300).selectExpr("id", "IF(id % 7 = 0, NULL, concat('S', id % 3)) AS suburb", "CAST(IF(id % 11 = 0, NULL, id % 4 + 1) AS int) AS bedrooms", "'x' AS kind")
    comps = spark.range(200).selectExpr("1000 - id AS comp_id", "concat('S', id % 4) AS suburb", "CAST(id % 5 + 1 AS int) AS bedrooms", "IF(id % 13 = 0, NULL, id % 9 * 1.0) AS price")
    near = spark.sql("SELECT a.s AS suburb, b.s AS other, abs(a.i - b.i) * 4.0 AS km FROM VALUES ('S0', 0), ('S1', 1), ('S2', 2), ('S3', 3) AS a(s, i) JOIN VALUES ('S0', 0), ('S1', 1), ('S2', 2), ('S3', 3) AS b(s, i) ON abs(a.i - b.i) <= 2")
    c, n = [tuple(x) for x in comps.collect()], [tuple(x) for x in near.collect()]
    want = set()
    for i, suburb, beds, _ in rows.collect():
        if suburb is not None and beds is not None:
            met = sorted((km, abs(b - beds), comp) for s, o, km in n if s == suburb for comp, at, b, price in c if at == o and price and abs(b - beds) <= 1)
            want |= {(i, comp, float(km), r) for r, (km, _, comp) in enumerate(met[:5], 1)}
    got = ladder.nearest(rows, comps, near, 5)
    assert {(r.id, r.comp_id, float(r.km), r["rank"]) for r in got.collect()} == want and len(want) > 500
    assert "windowspecdefinition(id#" not in plan(got)  # no window over a listing's own pairs


def test_unique_match_meets_keys_and_not_listings(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "id % 10 AS lot", "id % 4 AS street")
    listings = spark.range(40).selectExpr("100 + id AS id", "IF(id < 20, id % 8, NULL) AS lot", "id % 3 AS street").union(spark.sql("SELECT 103L, 3L, 0L"))
    rules = [("both", ["lot", "street"]), ("lot", ["lot"])]
    d, l = docs.collect(), listings.collect()
    want = set()
    for x in d:
        for rule, keys in rules:
            if hit := {y.id for y in l if all(x[k] == y[k] for k in keys)}:
                want |= {(x.doc_id, min(hit), rule)} if len(hit) == 1 else set()
                break
    got = names.unique_match(docs, listings, rules)
    assert {tuple(r) for r in got.collect()} == want and want
    assert "Window" not in plan(got)


def test_grid_rows_are_never_broadcast(spark):
    bodies = spark.range(50).selectExpr("id", "concat('C:7=Size@2;C:5=Lot@1;D:x/5/A', id, '//0;D:y/7//20/0;') AS body")
    got = files.grid_rows(bodies, r"C:(\d+)=(\w+)@(\d+);", r"D:(\w+)/(\d+)/(\w*)/([\d.]*)/(\d+);")
    want = {(i, n, c) for i in range(50) for n, c in ((0, ("Lot", "Size")), (1, (f"A{i}", "")), (2, ("", "20")))}
    assert {(r.id, r.row_no, tuple(r.cells)) for r in got.collect()} == want
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_registry_of_any_length_is_searched(spark):
    reg = spark.range(20_005).selectExpr("concat('Builder #', id) AS builder_name", "-id AS ord")
    asked = spark.createDataFrame([("20003",), ("the builder #77 of old",), ("er",), ("nobody",)], "name string")
    assert {r.name: r.builder_name for r in files.find_builder(reg, asked).collect()} == {"20003": "Builder #20003", "the builder #77 of old": "Builder #77", "er": "Builder #20004", "nobody": None}


def test_names_with_one_beginning_meet_whole(spark):
    known = spark.range(30).selectExpr("concat('Supplier#', lpad(id, 4, '0')) AS name")
    labels = known.selectExpr("concat('The ', upper(name), ' and ', IF(name > 'Supplier#0019', name, 'Supplier#0001')) AS label")
    got = audits.contained_labels(labels, known)
    assert {tuple(r) for r in got.collect()} == {(f"The SUPPLIER#{i:04d} and Supplier#{i if i > 19 else 1:04d}", f"Supplier#{i:04d}") for i in [1, *range(20, 30)]}
    texts = known.selectExpr("name AS id", "concat('stock of ', lower(name), ', supplier 0003') AS text")
    said = audits.mentions(texts, known)
    assert {tuple(r) for r in said.collect()} == {(f"Supplier#{i:04d}", f"Supplier#{min(i, 3):04d}") for i in range(30)}
    assert all("contains(" not in plan(df).lower() for df in (got, said))


def test_numbers_of_lots_and_stages_have_any_length(spark):
    row = spark.range(1).select(text.lot_number(F.lit("lot 1234567A here")).alias("lot"), F.lit("Stage 123456").rlike(names.NOT_A_COMPANY).alias("stage"), F.lit("Stage 12 Homes").rlike(names.NOT_A_COMPANY).alias("homes")).first()
    assert tuple(row) == ("1234567A", True, False)


def test_no_fact_of_a_line_is_written_out_twice_over(spark):
    """Each step of a reading is computed once: written out at every use, plans grew by a factor a step, and the time per line with them."""
    line = spark.range(1).selectExpr("concat('Lot ', id) AS line")
    t = F.col("line")
    facts = {"variant": values.variant_key(t), "rooms": text.specs(t), "gift": text.incentive(t), "storey": text.storey(t), "tail": links.address_tail(t)["street"], "judged": listing.judge(t), "price": rows.price_fields(t, rows.stated_prices(t))}
    plans = {k: plan(line.select(c.alias("x"))).lower() for k, c in facts.items()}
    steps = {k: p.count("regexp_") + p.count("rlike") for k, p in plans.items()}
    assert {k for k, n in steps.items() if n > 80} == set(), steps


def test_a_long_lot_names_its_address(spark):
    line = F.lit("Lot 1234567 4 bed 2 bath 350 m2 $300,000 $250,000 $1,784,567")
    assert spark.range(1).select(rows.address_label(line, text.lot_number(line), F.lit("Aberdeen"))).first()[0] == "Lot 1234567, Aberdeen"


def test_numbers_meet_by_sets_and_not_by_rows(spark, monkeypatch):
    """Rows of the same numbers are one side of a pair, however many they are; each still hears of the others of its own set."""
    said = lambda *n: " ".join(map(str, n))
    texts = [said(1, 2, 3, 4, 5)] * 40 + [said(1, 2, 3, 4, 5, 6)] * 30 + [said(1, 2, 3, 9)] * 5 + [said(1, 2, 3, 4, 7, 8)] * 2 + [said(2, 3, 4, 5, 6, 11, 12)]
    rows = [(i, 100.0, t, None if i % 4 == 0 else "abc"[i % 3] if i != 41 else "z") for i, t in enumerate(texts)]
    met, matches = [], names.fingerprint_matches
    monkeypatch.setattr(names, "fingerprint_matches", lambda r, *a, **k: met.append(r.count()) or matches(r, *a, **k))
    df = spark.createDataFrame(rows, "id int, price double, source_text string, builder string")
    named = df.where("builder IS NOT NULL").select("id", "builder")
    got = {tuple(r) for r in pooled._by_numbers(df, named, df.select("id", df.builder.alias("own"))).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, rows[i][3], b) for i in range(len(rows)) for j, (*_, b) in enumerate(rows) if b and i != j and len(sets[i] & sets[j]) >= 5}
    assert got == want and (40, None, "z") in got and (41, "z", "z") not in got
    assert met == [4]


def test_supersede_follows_only_rows_that_have_not_ended(spark, monkeypatch):
    """A long chain beside many rows that end at once: the rows written per round fall, and rows dealt out by their line are not dealt out again."""
    chain = [(i, f"L{i // 2}", f"t{(i + 1) // 2}", i) for i in range(32)]  # lots and lines alternate: each row leads to the next
    ends = [(100 + i, f"M{i // 2}", f"u{i}", i) for i in range(200)]
    df = spark.createDataFrame(chain + ends, "id int, lot string, txt string, fresh int")
    written, cut = [], captures.cut
    monkeypatch.setattr(captures, "cut", lambda d: written.append((out := cut(d)).count()) or out)
    got = {(r.id, r.survivor) for r in captures.supersede(df, ["lot"], ["lot"], ["txt"], ["fresh"]).collect()}
    assert got == {(i, 31) for i in range(31)} | {(100 + i, 101 + i) for i in range(0, 200, 2)}
    assert written[0] == 131 and max(written[1:]) < 31 and sum(written) < 300
    dealt = df.repartition("txt")
    two = captures.losers(dealt.where("txt IS NOT NULL"), ["txt"], ["fresh"], nulls=False)
    assert two._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # each side of the join by its own reading of the same rows


def test_brochures_meet_sums_of_listings_and_designs_are_dealt_out(spark, monkeypatch):
    """One lot, one street and one design that very many files and listings share: files meet sums of keys, and a design's pieces are several tasks."""
    monkeypatch.setattr(brochures, "FILES", 10)
    listing = [(i, "B0", "7", "12 High Street", None, None, "Lot of OTHER" if i % 5 else "Lot of VESPER") for i in range(100)] + [(100, "B0", "8", "14 Low Road", None, None, "KESTREL"), (101, None, "9", "1 A St", None, None, "TUVALA")]
    named = ["Lot 7.pdf", "12 High Road flyer.pdf", "draft vesper x.pdf", "Lot 8.pdf", "14 Low Road.pdf", "kestrel.pdf"]
    docs = [(i, "b0", named[i % 6]) for i in range(240)] + [(900, None, "Lot 9 tuvala.pdf"), (901, None, "Lot 7 vesper.pdf")]
    rows = spark.createDataFrame(listing, "id int, builder string, lot_number string, lot_address string, suburb string, estate_name string, source_text string")
    out = brochures.match(spark.createDataFrame(docs, "doc_id int, builder string, filename string"), rows)
    want = {(i, j, "design") for i in range(2, 240, 6) for j in range(0, 100, 5)} | {(i, 100, r) for i in range(240) for k, r in ((3, "lot"), (4, "street"), (5, "design")) if i % 6 == k} | {(900, 101, "lot and word")}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    key = [("b0", "vesper")]
    dealt = brochures._dealt(spark.createDataFrame([(i, *key[0]) for i in range(80)], "doc_id int, b string, word string"), spark.createDataFrame([(i, *key[0]) for i in range(20)], "id int, b string, word string"))
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()  # one key, several tasks
    assert sum(r[1] for r in sizes) == 1600 and len(sizes) > 1


def test_members_of_tiers_are_dealt_to_many_tasks(spark, sf_dir, monkeypatch):
    """A few listings and comparables make many members, however few bytes they are: they are dealt by their number, and results stay as they are."""
    from terrace.plans import shortlist

    rows, comps, near = shortlist._comparables(spark, sf_dir)
    whole = sorted(map(tuple, ladder.competitive(rows, comps, near).collect()))
    monkeypatch.setattr(ladder, "TASK_MEMBERS", 100)
    choices = ladder._grouped(ladder._chosen(ladder.tier_counts(rows, comps, near)).where("n_comps >= 4"))
    tasks, pieces = ladder.shares(choices)
    dealt = ladder.members(choices, comps, near, tasks, pieces)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 4 and dealt.count(f", {tasks}), REPARTITION_BY_NUM") >= 2
    assert sorted(map(tuple, ladder.competitive(rows, comps, near).collect())) == whole


def test_fingerprints_are_dealt_by_the_pairs_that_may_meet(spark, monkeypatch):
    """One price, numbers that very many rows have and more numbers than have bits: many tasks however few bytes, no task with a whole number, and all pairs once."""
    monkeypatch.setattr(names, "BLOCK_ROWS", 16)
    monkeypatch.setattr(names, "TASK_PAIRS", 1024)
    plans, deal = [], names._dealt
    monkeypatch.setattr(names, "_dealt", lambda *a: plans.append(deal(*a)) or plans[-1])
    r = random.Random(3)
    data = [(i, 100.0, [float(x) for x in {r.randrange(3), *(r.randrange(3, 400) for _ in range(8)), *((500, 501) if i % 40 == 0 else ())}]) for i in range(240)]
    for least in (1, 2):
        got = sorted(map(tuple, names.fingerprint_matches(spark.createDataFrame(data, "id int, price double, numbers array<double>"), least=least).collect()))
        sets = [set(n) for *_, n in data]
        assert got == [(a, b, n) for a in range(240) for b in range(a + 1, 240) if (n := len(sets[a] & sets[b])) >= least]
    dealt = plans[0]
    assert dealt.rdd.getNumPartitions() > 4
    cells = dealt.groupBy("g", "x", "y").agg(F.count_if("as_a").alias("a"), F.count_if("as_b").alias("b"))
    assert cells.agg(F.max("a"), F.max("b")).first()[0] < 40 and cells.groupBy("g").count().agg(F.max("count")).first()[0] >= 16


@pytest.mark.parametrize("block", [1000, 16])
def test_rows_of_a_crowded_price_travel_once(spark, monkeypatch, block):
    """A price whose rows mostly share numbers is dealt out by its rows, once for both sides of a pair; one of rare numbers still by its numbers. All pairs once either way."""
    for name, value in (("FEW_ROWS", 8), ("BLOCK_PRICE", block)):
        monkeypatch.setattr(names, name, value, raising=False)
    dealt, cells = [], getattr(names, "_cells", None)
    monkeypatch.setattr(names, "_cells", lambda *a: dealt.append(cells(*a)) or dealt[-1], raising=False)
    r = random.Random(5)
    crowded = [(i, 100.0, [float(x) for x in {r.randrange(4), *(r.randrange(70, 90) for _ in range(4)), *((91, 92) if i % 30 == 0 else ())}]) for i in range(120)]
    rare = [(200 + i, 300.0, [float(x) for x in {r.randrange(2000) for _ in range(9)}]) for i in range(150)]
    few = [(400 + i, 500.0, [1.0, 2.0, 3.0 + i % 2, None]) for i in range(5)] + [(410, 600.0, [1.0, 2.0]), (411, None, [1.0, 2.0]), (412, 500.0, None)]
    sets = {i: (p, {x for x in v or [] if x is not None}) for i, p, v in [*crowded, *rare, *few] if p is not None}
    for least in (1, 2):
        out = names.fingerprint_matches(spark.createDataFrame(crowded + rare + few, "id int, price double, numbers array<double>"), least=least)
        want = [(a, b, n) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and (n := len(sets[a][1] & sets[b][1])) >= least]
        assert sorted(map(tuple, out.collect())) == sorted(want)
        done = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert any("ReusedExchange" in x and "REPARTITION_BY_NUM" in x for x in done.splitlines())
    whole = dealt[0].groupBy("id").agg(F.count("*").alias("copies"))
    ids = {x.id: x.copies for x in whole.collect()}
    assert set(range(120)) <= set(ids) and not any(200 <= i < 400 for i in ids)
    assert max(ids.values()) == (1 if block == 1000 else 15)  # of eight blocks a row is dealt to 15 cells
