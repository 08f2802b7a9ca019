import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from terrace.operators import captures, channels, gates, geo, guards, ladder, lines, names, peers, places, score

PEER = "id long, state string, suburb string, product_type string, bedrooms int, price double"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_peers_leave_themselves_out(spark):
    df = spark.createDataFrame([(i, "VIC", "A", "house", 4, p) for i, p in enumerate([500.0, 500.0, 510.0, 520.0, 530.0, 540.0])], PEER)
    got = dict(rows(peers.benchmark(df), "id", "median"))
    assert got[0] == 520.0 and got[5] == 510.0 and got[1] == got[0]


def test_peers_refuse_small_and_scattered_groups_and_nulls(spark):
    few = [(i, "VIC", "A", "house", 4, 500.0) for i in range(5)]
    wide = [(10 + i, "VIC", "B", "house", 4, 100.0 * (i + 1) ** 2) for i in range(10)]
    null = [(30 + i, "VIC", None, "house", 4, 500.0) for i in range(8)]
    assert peers.benchmark(spark.createDataFrame(few + wide + null, PEER)).count() == 0


def test_tiers_take_rows_out(spark):
    df = spark.createDataFrame([(i, "VIC", "A", "house", 4 if i < 6 else i, 500.0) for i in range(13)], PEER)
    got = dict(rows(peers.assign_tiers(df), "id", "tier"))
    assert all(got[i] == 1 for i in range(6)) and all(got[i] == 2 for i in range(6, 13))


CAP = "id long, lot string, beds int, txt string, fresh int"


def test_supersede_follows_the_chain_and_never_repoints(spark):
    df = spark.createDataFrame([(1, "L", 3, "t1", 1), (2, "L", 3, "t2", 2), (3, None, 3, "t2", 3), (4, None, None, "t1", 9), (5, "M", None, "t5", 1), (6, "M", None, "t6", 2)], CAP)
    got = rows(captures.supersede(df, ["lot", "beds"], ["lot"], ["txt"], ["fresh"]), "id", "survivor")
    # 1 lost its lot to 2 and keeps that winner although 4 has its text; 2 lost to 3; null specs match each other
    assert got == [(1, 3), (2, 3), (5, 6)]


def test_supersede_is_the_same_for_any_partitioning(spark):
    data = [(i, f"L{i % 7}", i % 2, f"t{i % 11}", (i * 37) % 13) for i in range(200)]
    run = lambda n: rows(captures.supersede(spark.createDataFrame(data[::-1] if n > 1 else data, CAP).repartition(n), ["lot", "beds"], ["lot"], ["txt"], ["fresh"]), "id", "survivor")
    assert run(1) == run(7)


def test_merge_rules_and_idempotence(spark):
    old = spark.createDataFrame([(1, 100.0, "a", None, "x"), (2, 200.0, "b", 150.0, "")], "k int, price double, note string, before double, detail string")
    new = spark.createDataFrame([(1, 110.0, "", None, "y"), (2, None, "c", None, "z"), (3, 300.0, "d", None, "w")], "k int, price double, note string, before double, detail string")
    rules = {"price": captures.STATED, "note": captures.STATED, "detail": captures.FILL}
    once = captures.merge(old, new, "k", rules, {"price": "before"})
    assert rows(once, "k", "price", "before", "note", "detail", "outcome") == [(1, 110.0, 100.0, "a", "x", "updated"), (2, 200.0, 150.0, "c", "z", "updated"), (3, 300.0, None, "d", "w", "new")]
    again = captures.merge(once.drop("outcome"), new, "k", rules, {"price": "before"})
    assert [r[0] for r in rows(again, "outcome")] == ["unchanged"] * 3


def test_variant_ordinals_repeat_for_equal_rows(spark):
    df = spark.createDataFrame([(0, "h", "a"), (1, "h", "b"), (2, "h", "a"), (3, "g", "z")], "row int, key string, sig string")
    assert rows(captures.variant_ordinals(df, "key", ["sig"], "row"), "row", "variant_ordinal") == [(0, 0), (1, 1), (2, 0), (3, 0)]


def test_gates_name_the_first_reason(spark):
    df = spark.createDataFrame([(1, "", "NSW", "Available", 100.0, "A", 3), (2, "x", "NSW", "Available", 100.0, "A", 3), (3, "", None, "sold", 100.0, "A", 3), (4, "", "NSW", "gone?", 100.0, "A", 3), (5, "", "NSW", "available", 100.0, "A", None)], "id int, superseded_by string, home string, availability string, price double, suburb string, bedrooms int")
    got = dict(rows(gates.gated(df, {"states": ["NSW"], "budget": 1000.0, "bedrooms_min": 3}), "id", "gate_reason"))
    assert got == {1: None, 2: "superseded", 3: "state unknown", 4: "availability unstated", 5: "incomplete"}
    free = dict(rows(gates.gated(df, {"states": ["NSW"], "budget": 1000.0}), "id", "gate_reason"))
    assert free[5] is None


GAZ = [("Austral", "NSW"), ("Denman", "NSW"), ("Denman", "QLD"), ("Kings Park", "VIC"), ("Park", "VIC"), ("Grove", "VIC")]


LOCALITIES = [
    ("AUSTRAL", "NSW", None, ("Austral", "stated")), ("Kemps Estate | 155 Boyd Avenue, Austral 2179", "NSW", None, ("Austral", "composite")), ("Rooms m2", "NSW", None, (None, "not a place")), ("Austral", None, None, ("Austral", "unchecked")), ("Grove", None, None, (None, "not a place")),
    (None, "NSW", None, (None, "absent")), ("Stage 2 Kings Park", "VIC", None, ("Kings Park", "composite")), ("Offer", None, "x", (None, "no state")), (" ", None, None, (None, "absent")),
    # the column has the street's name, the address has the place before its postcode; each alone changes nothing
    ("Denman", "NSW", "LOT 2950 DENMAN RD, Austral 2179", ("Austral", "address")), ("Denman", "NSW", "LOT 2950 Denman, Austral 2179", ("Denman", "stated")), ("Denman", "NSW", "12 Denman Rd, Denman 2328", ("Denman", "stated")), ("Denman", "NSW", "1 Denman Road Austral 3024", ("Denman", "stated")),
    ("2026", "VIC", "Lot 4 Kings Park 3021", ("Kings Park", "postcode")), (None, "VIC", "Lot 2427, Newhaven; Kings Park 3021", ("Kings Park", "postcode")), ("2026", "VIC", "Kings Park 2021", (None, "not a place")), ("Austral", None, "132 Austral Street", (None, "not a place")), ("Logan", "QLD", None, (None, "not a place")), ("a(b", "QLD", "a(b street", (None, "not a place")),
]


def test_locality(spark):
    gaz = spark.createDataFrame(GAZ + [("Logan", "VIC")], "suburb string, state string")
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(LOCALITIES)] + [(None, "Austral", "NSW", None)], "id int, suburb string, state string, lot_address string")
    got = {r.id: (r.locality, r.why) for r in places.with_locality(df, gaz, texts=("lot_address",)).collect()}
    assert got == dict(enumerate(c[3] for c in LOCALITIES)) | {None: ("Austral", "stated")}


VOTE = "postcode string, suburb_states array<string>, page_state string, listing_state string"


@pytest.mark.parametrize(
    "row,want",
    [
        (("1028", ["VIC"], "VIC", None), ("VIC", "suburb + page")), (("3064", ["VIC"], "QLD", None), ("VIC", "postcode + suburb")), ((None, ["NSW", "QLD"], "NSW", None), ("NSW", "suburb + page")),
        (("2765", None, None, "queensland"), ("QLD", "listing")), (("2765", ["VIC"], None, None), (None, "")), ((None, None, "SA", None), ("SA", "page")), ((None, None, None, None), (None, "")),
    ],
)
def test_state_votes(spark, row, want):
    got = places.vote_state(spark.createDataFrame([row], VOTE)).select("voted_state", "signal").first()
    assert tuple(got) == want


def test_name_canonical(spark):
    known = spark.createDataFrame([("Hattan Homes", 1), ("Strike Development", 2), ("hattan.com.au", 3)], "name string, ord int")
    asked = spark.createDataFrame([("hattan.com.au",), ("STRIKE-development",), ("Strike Developments",), ("other.com",), ("New Co",)], "name string")
    got = dict(rows(names.canonical(asked, known), "name", "canonical"))
    assert got == {"hattan.com.au": "Hattan Homes", "STRIKE-development": "Strike Development", "Strike Developments": "Strike Development", "other.com": "other.com", "New Co": "New Co"}


def test_unique_match_stops_on_ambiguity(spark):
    docs = spark.createDataFrame([(1, "7", "x"), (2, "8", "y")], "doc_id int, lot string, street string")
    cand = spark.createDataFrame([(10, "7", "q"), (11, "7", "x2"), (12, "8", "z"), (13, "9", "x")], "id int, lot string, street string")
    assert rows(names.unique_match(docs, cand, [("lot", ["lot"]), ("street", ["street"])]), "doc_id", "listing_id", "rule") == [(2, 12, "lot")]


def test_alarms(spark):
    side = lambda **x: spark.createDataFrame(list(x.items()), "channel string, n long")
    got = rows(channels.alarms(side(a=0, b=5, c=30, d=3), side(a=10, b=100, c=40, d=5), side(b=30, c=30), "channel"), "channel", "alarm", "floor")
    assert got == [("a", "dead", 0), ("b", "collapsed", 25)]


def test_radius_join_equals_the_plain_one(spark):
    p = spark.createDataFrame([(i, -33.0 + (i * 7 % 40) / 20, 150.0 + (i * 11 % 60) / 20) for i in range(200)], "id int, lat double, lng double")
    o = p.where("id IN (3, 77)")
    fast, plain = geo.within_radius(p, o, 40.0), geo.within_radius(p, o, None).where("km <= 40")
    assert rows(fast, "id", "origin", "km") == rows(plain, "id", "origin", "km")


def test_price_structure_and_verdicts(spark):
    l = spark.createDataFrame([("f", "land $300,000 build $250,000 = $550,000"), ("f", "only $1,100,000 here")], "file string, line string")
    s = lines.price_structure(l, "file", "line")
    r = spark.createDataFrame([(1, "f", 300000.0, ""), (2, "f", 551000.0, ""), (3, "f", 999999.0, ""), (4, "f", 300000.0, "LAND ONLY"), (5, "g", 1.0, "")], "id int, file string, price double, text string")
    assert rows(lines.verify_price(r, s, "file"), "id", "verdict", "fix") == [(1, "COMPONENT", 550000.0), (2, "TOTAL", None), (3, "NOT FOUND", None), (4, "PART SOLD ALONE", None), (5, "NO EVIDENCE", None)]


def test_guards(spark):
    df = spark.createDataFrame([("mail me a@b.co", "0011091284", "h"), ("ok", "03 9123 4567", "x")], "notes string, code string, content_hash string")
    assert rows(guards.contact_violations(df), "column", "n") == [("code", 1), ("notes", 1)]
    with pytest.raises(ValueError):
        guards.require_none(guards.contact_violations(df), "contacts")
    with pytest.raises(ValueError):
        guards.publish_floor(700, 1000)
    with pytest.raises(ValueError):
        guards.publish_floor(499, None)
    with pytest.raises(ValueError):
        guards.check_write(["price", "suburb"])
    with pytest.raises(ValueError):
        guards.whitelist(["portal_login_password"], {"portal_login_password"})
    guards.publish_floor(900, 1000)


def test_builder_confidence(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (True, True, None, None, None), (True, False, True, False, None), (True, False, False, False, "direct")], "k boolean, m boolean, c boolean, p boolean, ch string")
    got = [r[0] for r in df.select(score.builder_confidence(F.col("k"), F.col("m"), F.col("c"), F.col("p"), F.col("ch"))).collect()]
    assert got == ["LOW", "HIGH", "MEDIUM", "LOW"]


NEAR = "suburb string, other string, km double"
COMP = "comp_id int, suburb string, kind string, bedrooms int, land_sqm double, price decimal(18,4), is_estimate boolean, is_new boolean"


def test_market_prefers_new_builds(spark):
    listing = spark.createDataFrame([(1, "a", "package", 3, 400.0, Decimal(100))], "id int, suburb string, kind string, bedrooms int, land_sqm double, price decimal(18,4)")
    comps = spark.createDataFrame([(i, "a", "package", 4, 900.0, Decimal(100 + i), False, i < 8) for i in range(20)], COMP)
    r = ladder.market(listing, comps, spark.createDataFrame([("a", "a", 0.0)], NEAR)).first()
    assert (r.established_used, r.tier, r.n_comps, r.mean) == (False, 3, 8, 103.5)


def plain_tiers(listing, comps, near, only_new=False):
    _, suburb, kind, beds, land, _ = listing
    out = {}
    for tier, d, tolerance, most in ladder.LADDER:
        out[tier] = [c for c in comps if (not only_new or c[7]) and (suburb, c[1]) in near and near[suburb, c[1]] <= most and c[2] == kind and c[3] is not None and abs(c[3] - beds) <= d and c[5] is not None and c[5] > 0
                     and (tolerance is None or land is None or (c[4] is not None and land * (1 - tolerance) <= c[4] <= land * (1 + tolerance)))]
    return out


def test_ladder_equals_all_pairs(spark):
    """Lands and prices that meet bounds exactly, nulls, several rows of one price, far suburbs, more bedrooms; a hot cell."""
    r = random.Random(4)
    km = {("a", "a"): 0.0, ("a", "b"): 4.0, ("b", "a"): 4.0, ("b", "b"): 0.0, ("a", "c"): 15.0, ("c", "c"): 0.0, ("d", "d"): 0.0}
    money = lambda: Decimal(r.choice([r.randint(1, 40) * 1000, r.randint(10_000, 90_000)])) / 1000
    comps = [(i, r.choice("aaaaabcx"), r.choice(["package", "package", "dwelling"]), r.choice([2, 3, 3, 3, 4, 5, None]), r.choice([None, 340.0, 400.0, 460.0, 280.0, 520.0, r.uniform(0.1, 900)]), r.choice([None, Decimal(0), money(), money(), money()]), False, r.random() < 0.3) for i in range(900)]
    listings = [(i, r.choice("aaabcd"), r.choice(["package", "dwelling"]), r.choice([2, 3, 4]), r.choice([None, 400.0, 400.0, 0.0, r.uniform(100, 900)]), r.choice([None, money(), money()])) for i in range(150)]
    df = (spark.createDataFrame(listings, "id int, suburb string, kind string, bedrooms int, land_sqm double, price decimal(18,4)"), spark.createDataFrame(comps, COMP), spark.createDataFrame([(*k, v) for k, v in km.items()], NEAR))
    chosen = {x.id: (x.tier, x.n_comps) for x in ladder.choose(*df).collect()}
    stats = {x.id: x for x in ladder.competitive(*df).collect()}
    market = {x.id: x for x in ladder.market(*df).collect()}
    seen = set()
    for row in listings:
        fits, fresh = plain_tiers(row, comps, km), plain_tiers(row, comps, km, True)
        tier = next((t for t in fits if len(fits[t]) >= 8), 5)
        prices = sorted(c[5] for c in fits[tier])
        n, own = len(prices), row[5]
        seen.add(tier)
        assert chosen[row[0]] == (tier, n)
        assert (row[0] in stats) == (n >= 4)
        if n >= 4:
            s, cents = stats[row[0]], lambda x: float(x.quantize(Decimal("0.01"), ROUND_HALF_UP))
            assert (s.median, s.p25, s.p75, s.cheapest) == tuple(map(cents, ((prices[(n - 1) // 2] + prices[n // 2]) / 2, prices[n // 4], prices[n * 3 // 4], prices[0])))
            assert s.percentile == pytest.approx(100 * sum(p < own for p in prices) / n if own is not None else 0, abs=0.051)
        best = next(((p, t, x[t]) for p, x in ((True, fresh), (False, fits)) for t in x if len(x[t]) >= 8 or (t == 5 and len(x[t]) >= 4)), None)
        assert (row[0] in market) == (best is not None)
        if best:
            m, mean = market[row[0]], sum(c[5] for c in best[2]) / len(best[2])
            assert (not m.established_used, m.tier, m.n_comps, m.mean) == (best[0], best[1], len(best[2]), float(mean.quantize(Decimal("0.01"), ROUND_HALF_UP)))
    assert len(seen) >= 4


def test_verdicts_of_many_prices_equal_all_pairs(spark):
    r = random.Random(3)
    structure = [(f, role, r.choice([250000.0, r.randint(2000, 2040) * 100.0, r.randint(0, 900) / 100 + 240000]), float(r.randint(400, 420) * 1000)) for f in "ab" for role in ("total", "component") for _ in range(30)]
    seen = [(i, r.choice("abc"), r.choice(structure)[2] + r.choice([0.0, 0.99, 1.0, -1.0, 2000.0, -2000.0, 2000.01, -2000.01, 4000.0]), r.choice(["x", "LAND ONLY"])) for i in range(300)]
    got = {x.id: (x.verdict, x.fix) for x in lines.verify_price(spark.createDataFrame(seen, "id int, file string, price double, text string"), spark.createDataFrame(structure, "file string, role string, amount double, total double"), "file").collect()}
    for i, file, price, text in seen:
        own = [s for s in structure if s[0] == file]
        fix = min((s[3] for s in own if s[1] == "component" and abs(price - s[2]) < 1), default=None)
        want = "PART SOLD ALONE" if text == "LAND ONLY" else "NO EVIDENCE" if not own else "TOTAL" if any(s[1] == "total" and abs(price - s[2]) <= 2000 for s in own) else "COMPONENT" if fix else "NOT FOUND"
        assert got[i] == (want, fix if want == "COMPONENT" else None)


def test_long_chains_of_labels_are_one_class(spark):
    from terrace.operators import repairs

    pairs = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)] + [("x", "y")], "a string, b string")
    got = rows(repairs.label_classes(pairs), "label", "class")
    assert {c for _, c in got} == {"n0000", "x"} and len(got) == 1003


def test_gates_doubt_channels_and_places(spark):
    df = spark.createDataFrame([(1, "Portal ", True), (2, "mail", False), (3, None, True)], "id int, source_channel string, located boolean")
    df = df.selectExpr("*", "'' AS superseded_by", "'NSW' AS home", "'for sale' AS availability", "1.0D AS price", "'A' AS suburb")
    got = dict(rows(gates.gated(df, {"states": ["NSW"], "unverified_channels": ["portal"]}), "id", "gate_reason"))
    assert got == {1: "price unverified", 2: "not a locality", 3: None}


def test_small_steps_of_a_run(spark):
    from terrace.operators import audits

    df = spark.createDataFrame([("a", 5.0, 1, "x", "NSW", "B"), ("b", 9.0, 0, None, None, "A"), ("c", None, 1, "y", None, "A")], "content_hash string, price double, promo_selected int, promo_selected_at string, state string, suburb string")
    assert [r[0] for r in audits.within_budget(df, 5.0).collect()] == ["a"]
    cleared = {r.content_hash: (r.promo_selected, r.promo_selected_at, r.changed) for r in audits.clear_marks(df).collect()}
    assert cleared == {"a": (0, None, True), "b": (0, None, False), "c": (0, None, True)}
    assert [r.content_hash for r in audits.promo_order(df).collect()] == ["c", "a"]
    off = audits.select_marks(df, df.where("content_hash = 'a'"), "content_hash", False, "now")
    assert {r.content_hash: r.promo_selected for r in off.collect()} == {"a": 0, "b": 0, "c": 1}
    assert [r.content_hash for r in audits.newest(df, "price", 2).collect()] == ["b", "a"]
    meta = spark.createDataFrame([("v", "1"), ("w", "2")], "key string, value string")
    assert {tuple(r) for r in audits.set_values(meta, spark.createDataFrame([("w", "3"), ("z", "4")], meta.schema)).collect()} == {("v", "1"), ("w", "3"), ("z", "4")}
    pages = spark.createDataFrame([("k", 1, None), ("k", 2, 7.0), ("m", 1, None)], "key string, page int, price double")
    once, withheld = audits.priced_once(pages, "key")
    assert [tuple(r) for r in once.collect()] == [("k", 2, 7.0)] and withheld.first().withheld == 1


def test_audits_of_empty_tables_and_nulls(spark):
    from terrace.operators import audits

    schema = "id long, postcode string, lot_address string, suburb string, source_text string, state string, state_source string, price double, product_type string, bedrooms int, bathrooms double, car_spaces int, house_sqm double, land_sqm double, estate_name string"
    for rows in ([], [tuple([1] + [None] * 14)]):
        df = spark.createDataFrame(rows, schema)
        assert all(f(df).count() == 0 for f in (audits.fabricated_postcodes, audits.understated_prices, audits.land_only, audits.rejected_today))
        assert audits.spec_audit(df).first().agree == 0 and audits.backfilled_specs(df).count() == len(rows)
    none = spark.createDataFrame([(None,)], "label string")
    assert audits.contained_labels(none, none.toDF("name")).count() == 0


@pytest.mark.parametrize("least", [1, 2, 5])
def test_fingerprints_equal_all_pairs(spark, least):
    """Numbers that every row has, that one row has, repeated numbers, null prices and numbers; prices that round to one."""
    r = random.Random(least)
    data = [(i, r.choice([100.0, 100.4, 250.0, None]), [7.0, 7.0, 1000.0 + i, *[float(r.randrange(25)) for _ in range(r.randint(0, 12))], *([None] if i % 9 == 0 else [])]) for i in range(160)] + [(900, 100.0, None), (901, 100.0, [])]
    got = names.fingerprint_matches(spark.createDataFrame(data, "id int, price double, numbers array<double>"), least=least)
    sets = {i: (round(p), {x for x in v or [] if x is not None}) for i, p, v in data if p is not None}
    want = [(a, b, n) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and (n := len(sets[a][1] & sets[b][1])) >= least]
    assert rows(got, "a", "b", "shared") == sorted(want)


def test_a_number_of_every_row_makes_nobody_meet(spark):
    data = [(i, 1.0, [5.0, *[float(100 + (i * 7 + k) % 3000) for k in range(6)]]) for i in range(2000)]
    prefixes = names.fingerprint_prefixes(spark.createDataFrame(data, "id int, price double, numbers array<double>"))
    assert prefixes.where("v = 5").count() == 0 and prefixes.groupBy("v").count().agg(F.max("count")).first()[0] < 20
