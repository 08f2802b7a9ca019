"""Header-typed sheets and proven states, against plain versions."""

import random
import re

from terrace.functions.values import POSTCODES, STATE_NAMES, STATES
from terrace.operators import sheets, states


# --- sheets ---
def plain_rows(rows):
    """rows: (n, cells, currency, header), in order."""
    labels, before, out = {}, False, {}
    for n, cells, currency, header in rows:
        if header:
            labels = labels if before else {}
            for i, c in enumerate(cells):
                if c:
                    labels[i] = f"{labels.get(i, '')} {c}".strip()
            before = True
            continue
        before = False
        money = {i for i, x in labels.items() if re.search(sheets.MONEY, x) and not re.search(sheets.NOT_MONEY, x)}
        fields = {}
        for i in sorted(labels):
            if not re.search(sheets.NO_FACT, labels[i]):
                for name, pattern, low, high in sheets.FACTS:
                    if re.search(pattern, labels[i]) and name not in fields:
                        fields[name] = (i, low, high)
                        break
        parts = []
        for i, c in enumerate(cells):
            try:
                value = float(c.replace(",", "")) if c and "$" not in c and (i in money or (currency and i < len(currency) and currency[i])) else 0
            except ValueError:
                value = 0
            parts.append(f"${value:,.0f}" if abs(value) >= 1000 else c or "")
        facts = []
        for name, *_ in sheets.FACTS:
            i, low, high = fields.get(name, (99, 0, 0))
            m = re.match(r"\d+(?:\.\d+)?", cells[i].strip().replace(",", "")) if i < len(cells) and cells[i] else None
            v = float(m[0]) if m and low <= float(m[0]) <= high else None
            facts.append(int(v) if v is not None and name in sheets.WHOLE_NUMBERS else v)
        out[n] = (re.sub(r"\s+", " ", " ".join(p for p in parts if p)).strip(), *facts)
    return out


def test_rows_equal_a_plain_reader(spark):
    r = random.Random(2)
    heads = ["Lot", "Land", "Price", "Size (sqm)", "Land Price", "Total", "Total (sqm)", "Bedrooms", "Beds", "Bath", "Garage", "Car Spaces", "House Size", "Lot Area", "Frontage", "Deposit", "", "Build price $", "Living area"]
    cells = ["519000.0", "519,000", "999", "1000", "$450,000", "4", "0", "45", "350.5", "12.5m", "abc", "", None, " 3 ", "2 cars", "1e5", "-2000", "nan"]
    data = []
    for file in "abc":
        for n in range(60):
            head = r.random() < 0.2
            k = r.randint(3, 8)
            data.append((file, n, [r.choice(heads if head else cells) for _ in range(k)], r.choice([None, [r.random() < 0.2 for _ in range(k)], [True]]), head))
    df = spark.createDataFrame(data, "file string, n int, cells array<string>, currency array<boolean>, head boolean")
    got = {(x.file, x.n): tuple(x)[2:] for x in sheets.read_rows(df, ["file"], "n", df["head"]).collect()}
    want = {(file, n): v for file in "abc" for n, v in plain_rows([d[1:] for d in data if d[0] == file]).items()}
    assert got == want


def test_two_columns_of_one_fact_and_blanks_only(spark):
    rows = [("f", 1, ["Lot", "Beds", "Bedrooms", "Land"], True), ("f", 2, ["", "", "", "Price"], True), ("f", 3, ["7", "4", "3", "519000"], False), ("f", 4, ["8", "45", "2", "700"], False)]
    df = spark.createDataFrame(rows, "file string, n int, cells array<string>, head boolean").selectExpr("*", "CAST(NULL AS array<boolean>) AS currency")
    facts = sheets.read_rows(df, ["file"], "n", df["head"]).cache()
    assert [(r.line, r.bedrooms) for r in facts.orderBy("n").collect()] == [("7 4 3 $519,000", 4), ("8 45 2 700", None)]
    listings = spark.createDataFrame([("f", 3, None, 2.0), ("f", 3, 0, 1.0), ("f", 3, 5, None), ("f", 9, None, None)], "file string, n int, bedrooms int, bathrooms double")
    assert [r.bedrooms for r in sheets.fill_blanks(listings, facts, ["file", "n"]).orderBy("n", "bathrooms").collect()] == [5, 4, 4, None]


# --- states ---
def plain_state(row, gaz):
    _, suburb, estate, address, postcode = row
    split = lambda c: [p.strip(" ") for p in re.split(r"[/|,]", c or "") if p.strip(" ")]
    of = lambda name: sorted(gaz.get(name.strip(" ").lower(), ()))
    digits = re.sub(r"\D", "", postcode or "")
    code = next((s for low, high, s in POSTCODES if len(digits) == 4 and low <= int(digits) <= high), None)
    for cell in (suburb, estate, address):
        for p in split(cell):
            if p.lower() in STATE_NAMES or p in STATES:
                return STATE_NAMES.get(p.lower(), p), states.STATED
        for p in split(cell):
            m = re.search(states.TOKEN, p)
            if len(p.split()) <= 5 and m and p.endswith(m[1]):
                return m[1], states.STATED
    loc = ""
    for cell in (suburb, estate):
        parts = split(cell)
        fit = [p for p in reversed(parts) if len(re.sub(states.TOKEN, "", p.upper()).strip(" -")) > 2] if len(parts) > 1 else []
        if fit:
            loc = " ".join(w for w in fit[0].split() if w.upper() not in STATES)
            break
    words = (suburb or "").split()
    if not loc and len(words) > 1 and not re.search(states.ADMINISTRATIVE, suburb):
        loc = next((t for i in range(len(words)) if of(t := " ".join(words[i:]))), "")
    if len(of(loc)) == 1:
        return of(loc)[0], states.LOCALITY
    if code and code in of(loc):
        return code, states.BOTH
    if code and code in of(suburb or ""):
        return code, states.WHOLE
    return None, None


GAZ = {"mambourin": ["VIC"], "armstrong creek": ["QLD", "VIC"], "creek": ["SA"], "smythes creek": ["VIC"], "logan": ["VIC"], "denman": ["NSW"], "springfield": ["NSW", "QLD", "TAS"], "wadalba": ["NSW"], "hobart": ["TAS"], "eden": ["NSW"], "dora creek": ["NSW"], "act": ["WA"]}
CELLS = [None, "", "Hobart", "Windermere Mambourin", "Warralily Armstrong Creek", "Smythes Creek", "CITY OF LOGAN", "Logan City Council", "STAGE 2 / DORA CREEK / NSW", "Highfields Estate, Denman", "Bethania QLD, Bethania", "BRISBANE NORTH QLD", "Springfield", "Lot 5, Springfield", "kearneys / qld", "Wa", "WA", "victoria | x", "10% Deposit", "Wadalba", "Redbank Plains Sienna Eden", "x, - NSW", "Armstrong Creek", "a b c d e f QLD", "QLD then NSW", "Lot 4 / Act", "one,two", "NSW / NT", "  Denman  Denman "]


def test_states_equal_a_plain_version(spark):
    r = random.Random(6)
    rows = [(i, c, None, None, None) for i, c in enumerate(CELLS)] + [(100 + i, r.choice(CELLS), r.choice(CELLS[:6] + ["The Grove", "A / Denman"]), r.choice([None, "118 Hobart Street", "1 A St, NSW"]), r.choice([None, "2259", "4207", "3215", "2026", "12", "0200"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, suburb string, estate_name string, lot_address string, postcode string")
    gaz = spark.createDataFrame([(n.title(), s) for n, all_ in GAZ.items() for s in all_] + [("Nowhere", "XX")], "suburb string, state string")
    got = {x.id: (x.own_state, x.proof) for x in states.proven_states(df, gaz).collect()}
    want = {row[0]: plain_state(row, GAZ) for row in rows}
    assert {k: (got[k], want[k], rows[k] if k < 100 else rows[k - 100 + len(CELLS)]) for k in want if got.get(k) != want[k]} == {}
    assert {p for _, p in got.values()} == {None, states.STATED, states.LOCALITY, states.BOTH, states.WHOLE}
