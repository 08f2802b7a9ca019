"""Keys of pooled rows, their measures and the names that they give, against a plain version that looks at every other row."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrace.operators import pooled

ROW = "id int, price double, lot_number string, land_sqm double, land_price double, build_price double, suburb string, source_text string"


def make(seed, n):
    r, rows, builders = random.Random(seed), [], {}
    stock = [(500_000.0 + 1000 * r.randrange(12), str(r.randint(1, 30)), r.choice([300.0, 350.5, 420.0]), r.choice(["Avon", "Box Hill", None])) for _ in range(25)]
    for i in range(n):
        price, lot, land, suburb = r.choice(stock)
        builder = r.choice(["alpha", "alpha", "beta", "gamma", "delta"])
        design = {"alpha": "VESPER", "beta": "Tuvala", "gamma": "Sodium", "delta": "VESPER"}[builder]
        text = f"Lot {lot} {r.choice([design, design, 'Available', 'Box'])} {land:g} sqm 4 2 2 12.{r.randint(0, 3)} ${price - 200_000:,.0f} $200,000 ${price:,.0f} {r.choice(['SOLD', 'Available', 'Titled Q3 2026', '5.2%'])}"
        rows.append((i, r.choice([price, price, price, None, 0.0]), r.choice([lot, lot.upper(), " ", None]), r.choice([land, None]), *(r.choice([(price - 200_000, 200_000.0), (None, 200_000.0)])), suburb, r.choice([text, text, text, "", None])))
        if r.random() < 0.75:
            builders[i] = builder
    return rows, builders


def plain_keys(row, places):
    i, price, lot, land, lp, bp, suburb, text = row
    t, lot, sub = text or "", (lot or "").strip().lower(), re.sub("[^a-z]", "", (suburb or "").lower())
    norm = re.sub(r"\s+", " ", t).strip().lower()
    for p in pooled.VOLATILE:
        norm = re.sub(p, " ", norm, flags=re.I)
    norm = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9.+]+", " ", norm)).strip()
    money = sorted({round(float(m.replace(",", ""))) for m in re.findall(r"\$\s?([\d,]+(?:\.\d+)?)", t) if float(m.replace(",", "")) >= 1000})
    words = {w.lower() for w in re.findall(r"\b([A-Z][a-zA-Z]{3,}|[A-Z]{4,})\b", t)} - set(pooled.PLAIN_WORDS) - places
    single = {
        "price_lot": (price, lot) if price and lot else None, "price_land": (price, round(land, 1)) if price and land else None, "text": norm if len(norm) >= 30 else None, "amounts": tuple(money) if len(money) >= 3 else None,
        "price_parts": (lp, bp, price) if lp and bp and price else None, "price_suburb": (price, sub) if price and sub else None, "price": price or None,
    }
    return {k: {v} if v is not None else set() for k, v in single.items()} | {"design": words, "design_often": words}


def plain_numbers(row):
    found = {round(float(x.replace(",", "")), 2) for x in re.findall(r"(?<![\w.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)", row[7] or "")}
    return found - {round(row[1], 2)} if row[1] else found


def plain_answer(kind, row, others, builders, keys):
    """Companies that other rows offer a row."""
    if kind == "numbers":
        return {builders[o[0]] for o in others if row[1] and o[1] == row[1] and len(plain_numbers(row) & plain_numbers(o)) >= 5}
    out = set()
    for key in keys[row[0]][kind]:
        n = Counter(builders[o[0]] for o in others if key in keys[o[0]][kind])
        if kind in pooled.WORDS:
            out |= {b for b, c in n.items() if len(n) == 1 and c >= (pooled.OFTEN if kind == "design_often" else 1)}
        else:
            out |= set(n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_measures_and_names_equal_a_look_at_every_row(spark, seed):
    rows, builders = make(seed, 220)
    places = {"box", "hill", "avon"}
    keys = {r[0]: plain_keys(r, places) for r in rows}
    named = [r for r in rows if r[0] in builders]
    df, who = spark.createDataFrame(rows, ROW), spark.createDataFrame(list(builders.items()), "id int, builder string")
    words = pooled.place_words(df, ["suburb"])
    assert {r.word for r in words.collect()} == places
    got = {r.kind: r for r in pooled.measure(df, who, words).collect()}
    kinds = (*pooled.WHOLE, *pooled.WORDS, pooled.NUMBERS)
    assert set(got) == set(kinds)
    for kind in kinds:
        a = [(builders[r[0]], plain_answer(kind, r, [o for o in named if o[0] != r[0]], builders, keys)) for r in named]
        b = [plain_answer(kind, r, [o for o in named if builders[o[0]] != builders[r[0]]], builders, keys) for r in named]
        want = (len(named), sum(len(x) == 1 for _, x in a), sum(x == {t} for t, x in a), sum(len(x) == 1 and x != {t} for t, x in a), sum(len(x) > 1 for _, x in a), sum(len(x) == 1 for x in b))
        assert (got[kind].rows, got[kind].answered, got[kind].right, got[kind].wrong, got[kind].ambiguous, got[kind].invented) == want, kind
    chosen = ["text", "price_lot", "design", "numbers"]
    pool = [r for r in rows if r[0] not in builders]
    names = {r.id: (r.builder, r.status, r.kinds) for r in pooled.name_rows(df.join(who, "id", "left_anti"), df.join(who, "id", "left_semi"), who, chosen, words).collect()}
    want = {}
    for r in pool:
        per = {k: x for k in chosen if (x := plain_answer(k, r, named, builders, keys))}
        if per:
            all_ = set().union(*per.values())
            want[r[0]] = (min(all_) if len(all_) == 1 else None, "accepted" if len(all_) == 1 else "conflict", "+".join(sorted(per)))
    assert names == want and len(want) > 20


def test_nobody_named(spark):
    df, who = spark.createDataFrame(make(3, 5)[0], ROW), spark.createDataFrame([], "id int, builder string")
    assert {(r.answered, r.invented, r.trusted) for r in pooled.measure(df, who).collect()} == {(0, 0, False)}
    assert pooled.name_rows(df, df.limit(0), who, ["text", "numbers"]).count() == 0
