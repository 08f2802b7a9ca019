"""Gates: every row gets the first reason against it, so one scan gives both the survivors and the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
ACCEPTED = ("available", "for sale", "in stock", "released", "selling", "titled", "now selling", "open")
REFUSED = (
    "sold", "under offer", "reserved", "leased", "on hold", "withdrawn", "not available", "unavailable", "not avail", "no longer available", "off market", "settled", "deposit taken", "contract pending",
)
BUDGET_SLACK = 50_000.0


def missing(labels: list[str]) -> Column:
    """The labels whose column is null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in labels]))


def gated(df: DataFrame, brief: dict) -> DataFrame:
    """df with ``gate_reason``, null for rows that pass. A fact is binding only if the brief sets its minimum. Cheap tests on
    stored columns come first in the chain; a caller that needs survivors alone filters on ``gate_reason IS NULL``. Where the brief names channels whose
    prices aren't verified, ``source_channel`` is read; where df has ``located`` (see places.with_locality), a suburb that isn't a locality fails."""
    state, said, price = F.col("home"), F.lower(F.trim("availability")), F.col("price")
    facts = [c for c, k in (("bedrooms", "bedrooms_min"), ("bathrooms", "bathrooms_min"), ("car_spaces", "car_spaces_min"), ("house_sqm", "house_min"), ("land_sqm", "land_min")) if brief.get(k)]
    ceiling = brief["budget"] + brief.get("slack", BUDGET_SLACK) if brief.get("budget") else float("inf")
    unverified = [c.lower() for c in brief.get("unverified_channels", ())]
    doubted = F.lower(F.trim("source_channel")).isin(*unverified) if unverified else F.lit(False)
    elsewhere = ~F.col("located") if "located" in df.columns else F.lit(False)
    reason = (
        F.when(F.coalesce("superseded_by", F.lit("")) != "", "superseded").when(state.isNull(), "state unknown").when(~state.isin(*brief["states"]), "other state").when(doubted, "price unverified").when(said.isNull(), "availability unstated")
        .when(said.isin(*REFUSED), "not available").when(~said.isin(*ACCEPTED), "availability unstated").when(price.isNull() | (price <= 0), "no price").when(price > ceiling, "over ceiling")
        .when(F.col("suburb").isNull(), "no suburb").when(elsewhere, "not a locality").when(F.size(missing(facts)) > 0, "incomplete")
    )
    return df.withColumn("gate_reason", reason)


def capped(df: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` rows by order, one row with kept and truncated): a list that is cut says by how much. The count is an aggregate, the cut a top-k."""
    n = df.agg(F.count("*").alias("n"))
    return df.orderBy(*order).limit(most), n.select(F.least("n", F.lit(most)).cast("long").alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("truncated"))
