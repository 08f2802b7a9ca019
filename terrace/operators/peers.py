"""Peer benchmark: tiers of peer groups, the median of the others, and a guard against groups that are not alike.

Plans: rows are counted once, on the finest key; the tiers are told on those counts (a tier's rows leave before the next) and joined back once (a hot
group's rows can be split by Spark). No group is ever held as an array: rows are ranked inside their group by a sort that can spill, the few order statistics that a
median without one's own price can need are picked by rank, and joined back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import band
from ..session import cut

MIN_PEERS = 5
MAX_DISPERSION = 2.5
TIERS = (("suburb + product type + bedrooms", ("state", "suburb", "product_type", "bedrooms")), ("suburb + product type", ("state", "suburb", "product_type")), ("suburb + bedrooms", ("state", "suburb", "bedrooms")))
BANDS, TOP = ((-10.0, "Below comparable stock"), (-2.5, "Slightly below comparable stock"), (2.5, "In line with comparable stock"), (10.0, "Above comparable stock")), "Well above comparable stock"


def assign_tiers(rows: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """rows with ``tier`` (1 to 3, null if in none): the tightest group of min_peers + 1 or more rows. A null key part keeps a row out of a tier."""
    finest = TIERS[0][1]
    cells = rows.groupBy(*finest).agg(F.count("*").alias("_n")).withColumn("tier", F.lit(None).cast("int"))
    for n, (_, keys) in enumerate(TIERS, 1):  # rows of a cell go the same way, so the tiers are told on cells alone
        named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        free = F.sum(F.when(F.col("tier").isNull() & named, F.col("_n"))).over(Window.partitionBy(*keys))
        cells = cells.withColumn("tier", F.coalesce("tier", F.when(named & (free > min_peers), F.lit(n))))
    c = cells.select(*[F.col(k).alias(f"_{k}") for k in finest], "tier")
    return rows.join(c, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in finest])).select(*rows.columns, "tier")


def group_key(tier: Column) -> Column:
    """One text for a row's group."""
    out = F.lit(None).cast("string")
    for n, (_, keys) in enumerate(TIERS, 1):
        out = F.when(tier == n, F.concat_ws("|", F.lit(str(n)), *[F.col(k).cast("string") for k in keys])).otherwise(out)
    return out


def _ranked(rows: DataFrame) -> DataFrame:
    placed = assign_tiers(rows).where("tier IS NOT NULL").withColumn("grp", group_key(F.col("tier")))
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("price", "id")) - 1)


def _statistics(ranked: DataFrame) -> DataFrame:
    """grp, n, spread (90th over 10th percentile, by index) and the prices around the middle of the others."""
    sized = ranked.groupBy("grp").agg(F.count("*").cast("int").alias("n"))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("price")))
    n, half = F.col("n"), F.floor((F.col("n") - 1) / 2).cast("int")
    tenth, ninth = F.floor(n * F.lit(0.1)).cast("int"), F.least(n - 1, F.floor(n * F.lit(0.9)).cast("int"))
    return ranked.select("grp", "rank", "price").join(sized, "grp").groupBy("grp", "n").agg(
        (at(ninth) / F.greatest(F.lit(1.0), at(tenth))).alias("spread"), at(half - 1).alias("q0"), at(half).alias("q1"), at(half + 1).alias("q2")
    )


def benchmark(rows: DataFrame) -> DataFrame:
    """rows with tier, n_peers, median (of the others), variance_pct and classification, for those in a group that is alike."""
    ranked = cut(_ranked(rows))  # sorted once, read for the statistics and for the rows
    out = ranked.join(_statistics(ranked).where(F.col("spread") <= MAX_DISPERSION), "grp")
    m = F.col("n") - 1
    half = F.floor(m / 2).cast("int")
    upper = F.when(half < F.col("rank"), F.col("q1")).otherwise(F.col("q2"))
    lower = F.when(half - 1 < F.col("rank"), F.col("q0")).otherwise(F.col("q1"))
    out = out.withColumn("n_peers", m).withColumn("median", F.when(m % 2 == 1, upper).otherwise((lower + upper) / 2)).where(F.col("median") > 0)
    out = out.withColumn("variance_pct", (F.col("price") - F.col("median")) / F.col("median") * 100)
    return out.withColumn("classification", band(F.col("variance_pct"), BANDS, TOP)).drop("q0", "q1", "q2", "rank", "grp", "n", "spread")


def dispersions(rows: DataFrame) -> DataFrame:
    """Each group's size and spread."""
    return _statistics(_ranked(rows)).select("grp", "n", "spread")
