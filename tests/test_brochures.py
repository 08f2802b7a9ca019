"""Brochures against a plain version that reads every row for every file."""

import random
import re

from terrace.operators import brochures

DOC = "doc_id int, builder string, filename string"
LISTING = "id int, builder string, lot_number string, lot_address string, suburb string, estate_name string, source_text string"


def plain(doc, listings):
    i, builder, name = doc
    builder, name = (builder or "").strip().lower(), name or ""
    lot = re.search(brochures.LOT, name)
    lot = (lot[1].lstrip("0") or "0") if lot else None
    stem = re.sub(r"[_\-]+", " ", re.sub(brochures.NOISE, " ", name))
    words = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z']{3,}", stem) if w.lower() not in brochures.NO_DESIGN]
    has = lambda word, text: re.search(rf"\b{re.escape(word)}\b", text or "", re.I)
    own_lot = lambda r: (r[2] or "").strip().lstrip("0")
    if not builder:
        if lot is None or not words:
            return set()
        hit = {r[0] for r in listings if own_lot(r) == lot and any(has(w, " ".join(x or "" for x in r[3:7])) for w in words)}
        return {(i, *hit, "lot and word")} if len(hit) == 1 else set()
    rows = [r for r in listings if (r[1] or "").strip().lower() == builder]
    if lot is not None:
        hit = [r[0] for r in rows if own_lot(r) == lot]
        if hit:
            return {(i, hit[0], "lot")} if len(hit) == 1 else set()
    street = re.search(brochures.STREET, name)
    if street:
        street = re.sub(r"[\s\-_]+", " ", f"{street[1]} {street[2]}").lower()
        hit = [r[0] for r in rows if street in re.sub(r"[\s\-_]+", " ", (r[3] or "").lower())]
        if len(hit) == 1:
            return {(i, hit[0], "street")}
    for w in words:
        hit = [r[0] for r in rows if has(w, r[6])]
        if hit and len(hit) <= max(3, len(rows) // 4):
            return {(i, x, "design") for x in hit}
    return set()


def test_levels_equal_a_look_at_every_row(spark):
    r = random.Random(8)
    streets = ["12 High St", "112 High Street", "7 Box-Hill Road", "7 Box Hill Rd", "5a Mc Low Way", "9 Highland Ave"]
    designs = ["Vesper", "VESPER", "Tuvala's", "O'Brien", "Sodium 24", "Available", "Banks_x", "Mirabélle"]
    listings = [(n, r.choice(["Acme", "acme ", "Beta", "Gamma Homes", None, ""]), r.choice(["7", "07", " 12", "0", "", None, str(r.randint(1, 60))]), r.choice([*streets, None]), r.choice(["Avon", None]), r.choice(["Vista Ridge", None]), r.choice([f"Lot {n} {r.choice(designs)} {r.choice(['Available', 'Sold'])}", None, ""])) for n in range(160)]
    listings += [(900, "Solo", "3", "1 One St", None, None, "Lonely Vesper")]
    names = ["Lot 7 Vesper.pdf", "L07_Vesper-brochure.pdf", "Lot-55 Tuvala.pdf", "Lot 0.pdf", "12 High Street flyer.pdf", "7_Box_Hill_Rd.pdf", "5A Mc-Low way v2.pdf", "O'Brien floor plan.pdf", "sodium final.pdf", "Available Vesper.pdf", "", None, "the homes.pdf", "Banks_x.pdf", "3 Avon ridge lot 12.pdf", "Lot 23 Vista.pdf", "Lot 41 Avon Sold.pdf", "9 High Ave.pdf", "mirab.pdf", "Lot 3 lonely.pdf"]
    docs = [(k, b, n) for k, (b, n) in enumerate((b, n) for b in ["ACME", "Beta", "gamma homes", "Solo", "nobody", " ", None] for n in names)]
    got = {tuple(x) for x in brochures.match(spark.createDataFrame(docs, DOC), spark.createDataFrame(listings, LISTING)).collect()}
    want = set().union(*[plain(d, listings) for d in docs])
    assert got == want
    assert {x[2] for x in got} == {"lot", "street", "design", "lot and word"}


def test_empty_tables(spark):
    docs, listings = spark.createDataFrame([(1, "a", "Lot 1 Vesper.pdf")], DOC), spark.createDataFrame([], LISTING)
    assert brochures.match(docs, listings).count() == 0 and brochures.match(docs.limit(0), listings).count() == 0
