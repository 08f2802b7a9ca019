"""Scores and decisions: one projection over joined inputs, then a total, a recommendation and a ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
EXTRAS = {"site": 15_000.0, "driveway": 5_000.0, "fencing": 4_000.0, "landscaping": 5_000.0, "flooring": 6_000.0, "blinds": 2_500.0, "hvac": 4_500.0}
PARTS = ("budget_fit", "requirement_match", "value_score", "location_score", "builder_score", "rental_fit", "risk_score")


@dataclass(frozen=True)
class Brief:
    budget_max: float
    preferred_cap: float
    bedrooms_min: int = 0
    bathrooms_min: int = 0
    car_spaces_min: int = 0
    house_min: float = 0.0
    land_min: float = 0.0
    storeys_max: int | None = None
    radius_km: float | None = None
    target_yield: float | None = None


def turnkey(df: DataFrame) -> DataFrame:
    """df with missing (items not included), extras (what they are allowed for), realistic and turnkey. A source that states
    nothing about inclusions is unclear, and only site costs are allowed for."""
    stated = F.coalesce("stated", F.lit(False))
    lacks = {"site": ~(stated & F.coalesce("site_fixed", F.lit(False)))} | {k: stated & F.coalesce(f"no_{k}", F.lit(False)) for k in EXTRAS if f"no_{k}" in df.columns}
    out = df.withColumn("missing", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in lacks.items()])))
    extras = sum((F.when(v, F.lit(EXTRAS[k])).otherwise(0.0) for k, v in lacks.items()), F.lit(0.0))
    n = F.size("missing")
    status = F.when(~stated, "Unclear").when((n == 0) & F.col("site_fixed"), "Full Turnkey").when(n <= 2, "Partial Turnkey").otherwise("Base Package")
    return out.withColumn("extras", extras).withColumn("realistic", F.col("advertised") + F.col("extras")).withColumn("turnkey", status)


def _at_least(v: str, minimum: float, cost: float) -> tuple[Column, Column]:
    """Points lost and whether it rejects: a value below the minimum does, one not stated costs a point."""
    below = F.coalesce(F.col(v) < minimum, F.lit(False))
    return F.when(F.col(v).isNull(), 1.0).when(below, cost).otherwise(0.0), below


def scored(df: DataFrame, b: Brief) -> DataFrame:
    """df with its parts, total (unrounded), rejected and reasons. Only an advertised price rejects, never an allowance."""
    d = turnkey(df)
    over = F.col("advertised") > b.budget_max
    room = b.budget_max - b.preferred_cap
    graded = 10 + 10 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (b.budget_max - F.col("realistic")) / room)) if room > 0 else F.lit(10.0)
    needs = {"bedrooms": (b.bedrooms_min, 10.0), "bathrooms": (b.bathrooms_min, 5.0), "car_spaces": (b.car_spaces_min, 5.0), "house_sqm": (b.house_min, 5.0)} | ({"land_sqm": (b.land_min, 5.0)} if b.land_min else {})
    losses, fails = zip(*[_at_least(k, *v) for k, v in needs.items()])
    tall = F.coalesce(F.col("storeys") > b.storeys_max, F.lit(False)) if b.storeys_max is not None else F.lit(False)
    unknown_storeys = F.when(F.col("storeys").isNull(), 2.0).otherwise(0.0) if b.storeys_max is not None and b.storeys_max < 2 else F.lit(0.0)
    far = F.coalesce(F.col("km") > b.radius_km, F.lit(True)) if b.radius_km else F.lit(False)
    reasons = [F.when(over, "over budget"), *[F.when(f, F.lit(f"{k} below minimum")) for k, f in zip(needs, fails)], F.when(tall, "too many storeys"), F.when(far, "outside the radius")]
    distance = F.when(F.col("in_primary"), 0.0).when(F.col("km").isNull(), 4.0).otherwise(F.least(F.lit(6.0), F.round(F.col("km") * 0.3, 1)))
    got = F.when(F.col("realistic") > 0, F.col("rent") * 52 / F.col("realistic") * 100).otherwise(0.0)
    short = F.greatest(F.lit(0.0), F.least(F.lit(5.0), (b.target_yield - got) * 2.5)) if b.target_yield else F.lit(0.0)
    zero = lambda c: F.greatest(F.lit(0.0), c)
    parts = {
        "budget_fit": F.when(over, 0.0).when(F.col("realistic") <= b.preferred_cap, 20.0).otherwise(graded),
        "requirement_match": zero(F.lit(20.0) - sum(losses, F.lit(0.0)) - unknown_storeys),
        "value_score": zero(F.least(F.lit(15.0), F.coalesce("value_points", F.lit(7.5)) - F.when(F.col("extras") > 15_000, 2.5).otherwise(0.0))),
        "location_score": zero(15.0 - distance),
        "builder_score": F.when(F.col("builder").contains("HIGH"), 10.0).when(F.col("builder").contains("MEDIUM"), 7.0).otherwise(4.0),
        "rental_fit": zero(10.0 - short),
        "risk_score": zero(10.0 - 5.0 * F.col("high_risks") - 2.0 * F.col("medium_risks")),
    }
    out = d.withColumns(parts).withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.withColumn("rejected", F.size("reasons") > 0).withColumn("total", sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0])))


def recommended(df: DataFrame) -> DataFrame:
    total = F.col("total")
    verdict = (
        F.when(F.col("verification") == "Pending", "Hold").when((F.col("verification") == "Unavailable") | F.col("rejected"), "Do Not Recommend")
        .when((total >= 80) & (F.col("high_risks") == 0), "Recommend").when(total >= 65, "Recommend with Conditions").otherwise("Hold")
    )
    return df.withColumn("recommendation", verdict)


def shortlist(df: DataFrame, k: int) -> DataFrame:
    """The k best verified rows (a top-k report), with rank; equal totals keep the order of ids."""
    from pyspark.sql import Window

    top = df.where((F.col("verification") == "Verified") & ~F.col("rejected")).orderBy(F.col("total").desc(), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "id")))


def pairwise(top: DataFrame) -> DataFrame:
    """Pairs of a shortlist, the better first."""
    a = top.select(F.col("rank").alias("ra"), F.col("id").alias("a"), F.col("total").alias("ta"), F.col("realistic").alias("pa"))
    b = top.select(F.col("rank").alias("rb"), F.col("id").alias("b"), F.col("total").alias("tb"), F.col("realistic").alias("pb"))
    return a.join(b, F.col("ra") < F.col("rb")).select("a", "b", F.round(F.col("ta") - F.col("tb"), 3).alias("lead"), (F.col("pa") < F.col("pb")).alias("cheaper"))


def failures() -> Column:
    checks = {"no distance": F.col("km").isNull(), "extras to confirm": F.col("turnkey") != "Full Turnkey", "no bedrooms": F.col("bedrooms").isNull(), "high risk": F.col("high_risks") > 0}
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]))


def builder_confidence(known: Column, marketplace: Column, contract: Column, portal: Column, channel: Column) -> Column:
    """A builder nobody knows is never a confident one."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~yes(known), "LOW").when(yes(marketplace) | (yes(contract) & yes(portal)), "HIGH").when(yes(contract) | yes(portal) | F.coalesce(channel == "email_pdf", F.lit(False)), "MEDIUM").otherwise("LOW")
