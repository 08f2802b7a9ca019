"""Packages side by side, and what keeps a shortlist from going out: sentences over joined figures, for any number of pairs and briefs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What two packages are compared by.
FACTS = ("builder", "realistic", "extras", "house_sqm", "land_sqm", "bedrooms", "bathrooms", "car_spaces", "total", "km", "advisories", "verification")

# --- fixed values: wording ---
LOWER = " lower once completion items are allowed for"
MORE_AREA = {"house_sqm": " m² more internal house area", "land_sqm": " m² more land"}
ROOMS = {"bedrooms": "bedroom", "bathrooms": "bathroom", "car_spaces": "car space"}
ALIKE = "Both options meet the brief on every figure recorded. The table below sets out the fields where they differ."
CHECKS = {
    1: "QA Item 1 Failed: Client Brief incomplete or budget max missing.",
    2: "QA Item 2 Failed: No candidate packages evaluated.",
    5: ("QA Item 5 Failed: Property ", " is Pending Confirmation without explicit consultant waiver.", "QA Item 5 Failed: Unavailable property ", " included in shortlist."),
    6: ("QA Item 6 Failed: Price breakdown missing for ", "."),
    11: ("QA Item 11 Failed: 100-point scoring matrix not calculated for ", "."),
}


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def _joined(*parts) -> Column:
    """Null if a part is."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def advantages(x: str, y: str) -> Column:
    """Where package x (a struct of ``FACTS``) beats y, as measured differences; what one of them doesn't state is no difference."""
    mine, theirs = lambda f: F.col(f"{x}.{f}"), lambda f: F.col(f"{y}.{f}")
    ahead = lambda f: mine(f) - theirs(f)
    stated = lambda f: (mine(f) != 0) & (theirs(f) != 0)
    allowed = F.coalesce(theirs("extras"), F.lit(0.0)) - F.coalesce(mine("extras"), F.lit(0.0))
    found = [F.when(stated("realistic") & (mine("realistic") < theirs("realistic")), _joined(_money(-ahead("realistic")), LOWER))]
    found += [F.when(stated(f) & (ahead(f) > 0), _joined(F.format_number(ahead(f), 0), said)) for f, said in MORE_AREA.items()]
    found += [F.when(ahead(f) > 0, _joined(F.call_function("format_number", ahead(f), F.lit("#.#")), " more ", said, F.when(ahead(f) > 1, "s").otherwise(""))) for f, said in ROOMS.items()]
    found.append(F.when(allowed > 0, _joined("hands over more complete — ", _money(allowed), " less to arrange separately")))
    found.append(F.when(ahead("total") > 0, _joined("scores ", F.format_number(mine("total"), 1), " against ", F.format_number(theirs("total"), 1), " on the brief")))
    found.append(F.when(ahead("km") < 0, _joined(F.format_number(-ahead("km"), 1), " km closer to the target suburb")))
    return F.array_compact(F.array(*found))


def to_confirm(x: str) -> Column:
    """What has to be settled about a package first: its advisories (cut at semicolons), and a status that isn't Verified."""
    notes = F.filter(F.transform(F.split(F.coalesce(F.col(f"{x}.advisories"), F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != "")
    status = F.col(f"{x}.verification")
    return F.concat(notes, F.array_compact(F.array(F.when((status != "Verified") & (status != ""), _joined("Listing status is ", F.lower(status))))))


def verdict(x: str, y: str, client: Column) -> Column:
    """One sentence on price and score; a lead is claimed only where there is one."""
    cost = lambda s: F.coalesce(F.col(f"{s}.realistic"), F.lit(0.0))
    score = lambda s: F.col(f"{s}.total")
    named = lambda first, other: F.coalesce(F.nullif(F.when(first, F.col(f"{x}.builder")).otherwise(F.col(f"{y}.builder")), F.lit("")), F.lit(other))
    gap = F.abs(cost(x) - cost(y))
    price = F.when(gap != 0, _joined(named(cost(x) <= cost(y), "Option 1"), " lands ", _money(gap), LOWER))
    best = F.format_number(F.greatest(score(x), score(y)), 1)
    both = score(x).isNotNull() & score(y).isNotNull()
    match = F.when(both & (score(x) != score(y)), _joined(named(score(x) > score(y), "it"), " scores higher against the brief (", best, " / 100)"))
    match = match.when(both, _joined("both score ", best, " / 100 against the brief"))
    parts = F.array_compact(F.array(price, match))
    buyer = F.coalesce(F.nullif(client, F.lit("")), F.lit("the buyer"))
    tail = _joined(". This compares what is recorded for each package — the fit with ", buyer, "’s priorities is a judgement for your consultant.")
    return F.when(F.size(parts) == 0, ALIKE).otherwise(_joined("On the figures the sources state, ", F.array_join(parts, ", and "), tail))


def compare(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, a_ahead, b_ahead, confirm_a, confirm_b, verdict for every pair (a, b, client) of rows (id and ``FACTS``). Pairs are met by id, so nothing
    but the pairs asked for is compared; a pair with an unknown id has no row."""
    side = lambda s: rows.select(F.col("id").alias(s), F.struct(*FACTS).alias(f"_{s}"))
    met = pairs.select("a", "b", "client").join(side("a"), "a").join(side("b"), "b")
    return met.select(
        "a", "b", advantages("_a", "_b").alias("a_ahead"), advantages("_b", "_a").alias("b_ahead"), to_confirm("_a").alias("confirm_a"), to_confirm("_b").alias("confirm_b"), verdict("_a", "_b", F.col("client")).alias("verdict")
    )


def checklist(briefs: DataFrame, candidates: DataFrame, shortlist: DataFrame) -> DataFrame:
    """brief, item, failure: why a brief's shortlist must not go out. briefs: brief, client, budget_max; candidates: brief; shortlist: brief, address,
    verification, approved, realistic, total. A brief without failures has no row."""
    note = lambda item, said: F.struct(F.lit(item).alias("item"), (said if isinstance(said, Column) else F.lit(said)).alias("failure"))
    tell = lambda df, *notes: df.select("brief", F.explode(F.array_compact(F.array(*notes))).alias("x")).select("brief", "x.*")
    counted = briefs.join(candidates.groupBy("brief").agg(F.count("*").alias("_n")), "brief", "left")
    incomplete = F.coalesce(F.col("client"), F.lit("")) == ""
    whole = tell(counted, F.when(incomplete | F.coalesce(F.col("budget_max") <= 0, F.lit(True)), note(1, CHECKS[1])), F.when(F.col("_n").isNull(), note(2, CHECKS[2])))
    at, status = F.coalesce("address", F.lit("not stated")), F.col("verification")
    pending, waived, gone, listed = CHECKS[5]
    each = tell(
        shortlist.join(briefs.select("brief"), "brief", "left_semi"), F.when((status == "Pending") & ~F.coalesce("approved", F.lit(False)), note(5, _joined(pending, at, waived))).when(status == "Unavailable", note(5, _joined(gone, at, listed))),
        F.when(F.col("realistic").isNull(), note(6, _joined(CHECKS[6][0], at, CHECKS[6][1]))), F.when(F.col("total").isNull(), note(11, _joined(CHECKS[11][0], at, CHECKS[11][1]))),
    )
    return whole.unionByName(each)
