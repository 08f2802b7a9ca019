"""Comparables: the tiers of the ladder are counted without pairs, then the first tier with enough is joined, once for all listings that share it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import band
from ..session import cut

#: tier, bedrooms either way, land either way (None: any), kilometres.
LADDER = ((1, 0, 0.15, 0.0), (2, 0, 0.30, 0.0), (3, 1, None, 0.0), (4, 0, None, 5.0), (5, 1, None, 15.0))
MIN_COMPS, MIN_ANY, HIGH_COMPS, TIGHT = 8, 4, 12, 2
ESTIMATE_SHARE = 0.3
MARKET_BANDS, MARKET_TOP = ((-0.05, "Below Market Value"), (0.05, "Competitive Market Value"), (0.12, "Slightly Above Market")), "Poor Value"


def nearest(rows: DataFrame, comps: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """id, comp_id, km, d, rank: the k nearest priced comparables of each listing (ids are unique), by distance, difference in bedrooms and id. What is near depends on
    suburb and bedrooms alone: the first k of each place and number of bedrooms are found, then those of each such pair of listings, which all listings of it share.
    near: suburb, other, km (each suburb is near itself at 0)."""
    c = comps.where("price > 0").select("comp_id", F.col("suburb").alias("other"), F.col("bedrooms").alias("c_beds"))
    first = c.withColumn("_r", F.row_number().over(Window.partitionBy("other", "c_beds").orderBy("comp_id"))).where(F.col("_r") <= k).drop("_r")
    cells = rows.select("suburb", "bedrooms").distinct().join(near, "suburb").withColumn("c_beds", F.explode(F.sequence(F.col("bedrooms") - 1, F.col("bedrooms") + 1)))
    met = cells.join(first, ["other", "c_beds"]).withColumn("d", F.abs(F.col("c_beds") - F.col("bedrooms")))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("suburb", "bedrooms").orderBy("km", "d", "comp_id"))).where(F.col("rank") <= k)
    return rows.select("id", "suburb", "bedrooms").join(ranked, ["suburb", "bedrooms"]).select("id", "comp_id", "km", "d", "rank")


CELL = ["suburb", "kind", "bedrooms"]
#: Steps of a factor of e that values are split into for running sums.
STEPS = 20
#: Members of groups that a task holds, about.
TASK_MEMBERS = 250_000


def running(df: DataFrame, keys: list[str], at: str, order: str, sums: list[str], tasks: int | None = None) -> DataFrame:
    """df with, for each of sums, its running sum per key by (at, order) as ``run_<name>``, the row itself included. The values of a key are split into bands, so that a
    key with very many of them is many tasks: a band sums its own rows and starts from the totals of those before, of which there are a few hundred. ``tasks``: how
    many share the rows; where it is left out, their bytes decide, which tell little of rows that compress well."""
    banded = df.withColumn("_band", F.floor(F.log(F.greatest(F.col(at).cast("double"), F.lit(1.0))) * STEPS).cast("int"))
    banded = banded.repartition(tasks, *keys, "_band") if tasks else banded
    total = banded.groupBy(*keys, "_band").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    ahead = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_band").alias("_b"), *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0)).alias(f"_s_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_band").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = banded.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_band") == F.col("_b")])
    return rows.join(start, same).select(*df.columns, *[(F.col(f"run_{c}") + F.col(f"_s_{c}")).alias(f"run_{c}") for c in sums])


def _priced(comps: DataFrame) -> DataFrame:
    return comps.where("price > 0 AND suburb IS NOT NULL AND kind IS NOT NULL AND bedrooms IS NOT NULL")


def _around(cells: DataFrame, near: DataFrame, *keep: str) -> DataFrame:
    """cells (CELL and keep) with other, beds, d, km: every cell of comparables that may be near enough, as keys of a join."""
    most = max(beds for _, beds, _, _ in LADDER)
    side = F.explode(F.sequence(F.col("bedrooms") - most, F.col("bedrooms") + most))
    return cells.join(near, "suburb").withColumn("beds", side).select(*CELL, *keep, "other", "km", "beds", F.abs(F.col("beds") - F.col("bedrooms")).alias("d"))


def tier_counts(rows: DataFrame, comps: DataFrame, near: DataFrame) -> DataFrame:
    """CELL, land_sqm (of the listings, each once) with n_<tier> and new_<tier>: how many priced comparables, and new ones, fit each tier. No
    listing meets a comparable for it: comparables are counted per cell; a tier with bounds on land (of the cell itself) is the difference of two running counts by land."""
    lands = _priced(comps).groupBy(*CELL, "land_sqm").agg(F.count("*").alias("n"), F.count_if("is_new").alias("new"))
    asked = rows.select(*CELL, "land_sqm").distinct()
    cells = lands.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("new").alias("new"))
    other = cells.select(F.col("suburb").alias("other"), "kind", F.col("bedrooms").alias("beds"), "n", "new")
    fits = {t: (F.col("d") <= beds) & (F.col("km") <= km) for t, beds, _, km in LADDER}
    whole = _around(asked.select(*CELL).distinct(), near).join(other, ["other", "kind", "beds"]).groupBy(*CELL).agg(*[F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(f"{c}_{t}") for t, ok in fits.items() for c in ("n", "new")])

    bounded = [(t, tolerance) for t, _, tolerance, _ in LADDER if tolerance is not None]
    land = F.col("land_sqm")
    ends = [F.struct(F.lit(t).alias("tier"), (land * x).alias("at"), F.lit(side).alias("side")) for t, tolerance in bounded for x, side in ((1 - tolerance, -1), (1 + tolerance, 1))]
    # below the lower end counts what is smaller, up to the upper end what is equal, too: ends sort before and after equal lands
    bounds = asked.where(land.isNotNull()).withColumn("e", F.explode(F.array(*ends))).select(*CELL, "land_sqm", "e.*", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("new"))
    known = lands.where(land.isNotNull()).select(*CELL, F.lit(None).cast("double").alias("land_sqm"), F.lit(None).cast("int").alias("tier"), land.cast("double").alias("at"), F.lit(0).alias("side"), "n", "new")
    run = running(known.unionByName(bounds), CELL, "at", "side", ["n", "new"]).where("side <> 0")
    inside = run.groupBy(*CELL, "land_sqm").agg(*[F.sum(F.when(F.col("tier") == t, F.col("side") * F.col(f"run_{c}"))).alias(f"in_{c}_{t}") for t, _ in bounded for c in ("n", "new")])
    both = asked.join(whole, CELL, "left").join(inside, [*CELL, "land_sqm"], "left")
    within = {t for t, _ in bounded}
    count = lambda c, t: F.coalesce(F.when(land.isNotNull(), F.col(f"in_{c}_{t}")).otherwise(F.col(f"{c}_{t}")) if t in within else F.col(f"{c}_{t}"), F.lit(0))
    return both.select(*CELL, "land_sqm", *[count(c, t).cast("int").alias(f"{c}_{t}") for t, *_ in LADDER for c in ("n", "new")])


def _with_choice(rows: DataFrame, choices: DataFrame) -> DataFrame:
    c = choices.select(*[F.col(k).alias(f"_{k}") for k in (*CELL, "land_sqm")], *[x for x in choices.columns if x not in (*CELL, "land_sqm")])
    return rows.join(c, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*CELL, "land_sqm")])).drop(*[f"_{k}" for k in (*CELL, "land_sqm")])


def _chosen(counts: DataFrame) -> DataFrame:
    """tier, n_comps, only_new: the first tier with MIN_COMPS, else the last tier."""
    last = LADDER[-1][0]
    tier = F.coalesce(*[F.when(F.col(f"n_{t}") >= MIN_COMPS, F.lit(t)) for t, *_ in LADDER], F.lit(last))
    n = F.coalesce(*[F.when(tier == t, F.col(f"n_{t}")) for t, *_ in LADDER])
    return counts.select(*CELL, "land_sqm", tier.alias("tier"), n.alias("n_comps"), F.lit(False).alias("only_new"))


def _chosen_pass(counts: DataFrame) -> DataFrame:
    """The same over new builds, then over all; cells with enough in neither are left out."""
    last = LADDER[-1][0]
    enough = [F.when((F.col(f"{c}_{t}") >= MIN_COMPS) | ((F.col(f"{c}_{t}") >= MIN_ANY) & F.lit(t == last)), F.struct(F.lit(t).alias("tier"), F.col(f"{c}_{t}").alias("n_comps"), F.lit(c == "new").alias("only_new"))) for c in ("new", "n") for t, *_ in LADDER]
    return counts.withColumn("x", F.coalesce(*enough)).where("x IS NOT NULL").select(*CELL, "land_sqm", "x.*")


def choose(rows: DataFrame, comps: DataFrame, near: DataFrame) -> DataFrame:
    """id, tier, n_comps: the first tier with MIN_COMPS, else the last tier."""
    return _with_choice(rows, _chosen(tier_counts(rows, comps, near))).select("id", "tier", "n_comps")


#: What tells apart the sets of comparables that listings are held against: land only where the tier asks for it.
GROUP = [*CELL, "land", "tier", "only_new"]


def _grouped(choices: DataFrame) -> DataFrame:
    bounded = [t for t, _, tolerance, _ in LADDER if tolerance is not None]
    return choices.withColumn("land", F.when(F.col("tier").isin(bounded), F.col("land_sqm").cast("double")))


def shares(groups: DataFrame) -> tuple[int, int]:
    """Tasks for the members of groups, and pieces of a cell's comparables, so that neither a task nor a cell's piece holds many more than TASK_MEMBERS."""
    sizes = groups.select(*GROUP, "n_comps").distinct().groupBy(*CELL).agg(F.sum("n_comps").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return -(-total // TASK_MEMBERS) or 1, -(-most // TASK_MEMBERS) or 1


def members(groups: DataFrame, comps: DataFrame, near: DataFrame, tasks: int, pieces: int) -> DataFrame:
    """GROUP, price, n: the priced comparables of each group's tier, counted by price. Only the chosen tier's comparables are joined, and once for all listings
    that are held against the same. A few groups and comparables make very many members: ``tasks`` share them, and a cell's comparables are dealt by price."""
    tiers = {t: (beds, tolerance, km) for t, beds, tolerance, km in LADDER}
    pick = lambda k: F.coalesce(*[F.when(F.col("tier") == t, F.lit(x[k])) for t, x in tiers.items()])
    c = _priced(comps).groupBy(F.col("suburb").alias("other"), "kind", F.col("bedrooms").alias("beds"), F.col("land_sqm").cast("double").alias("c_land"), "price", "is_new").agg(F.count("*").alias("n"))
    c = c.withColumn("piece", F.pmod(F.xxhash64("price"), F.lit(pieces)))
    places = _around(groups.select(*GROUP).distinct(), near, "land", "tier", "only_new").where((F.col("d") <= pick(0)) & (F.col("km") <= pick(2)))
    places = places.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))))
    at = ["other", "kind", "beds", "piece"]
    land = F.col("land")
    fits = pick(1).isNull() | land.isNull() | F.col("c_land").between(land * (1 - pick(1)), land * (1 + pick(1)))
    met = places.repartition(tasks, *at).join(c.repartition(tasks, *at), at).where(fits & (~F.col("only_new") | F.col("is_new")))
    return met.select(*GROUP, "price", "n").repartition(tasks, *GROUP, "price").groupBy(*GROUP, "price").agg(F.sum("n").alias("n"))


def _join_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(*[F.col(k).alias(f"_{k}") for k in GROUP], *[x for x in groups.columns if x not in GROUP])
    return rows.join(g, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GROUP])).drop(*[f"_{k}" for k in GROUP])


def competitive(rows: DataFrame, comps: DataFrame, near: DataFrame) -> DataFrame:
    """Statistics of the chosen tier, for listings with MIN_ANY comparables: only tight tiers may flag or pass. Prices are best given as decimals:
    the middle of two of them is then exact. A listing's percentile is read from the same running count as the quantiles."""
    choices = cut(_grouped(_chosen(tier_counts(rows, comps, near)).where(F.col("n_comps") >= MIN_ANY)))  # read four times
    asked = _with_choice(rows, choices).withColumn("own", F.col("price"))
    sizes = choices.select(*GROUP, "n_comps").distinct()
    tasks, pieces = shares(choices)
    prices = members(choices, comps, near, tasks, pieces).withColumn("side", F.lit(1))
    owns = asked.select(*GROUP, "price").distinct().withColumn("n", F.lit(0).cast("long")).withColumn("side", F.lit(0))  # before equal prices: those below count
    run = cut(running(prices.unionByName(owns.where("price IS NOT NULL")), GROUP, "price", "side", ["n"], tasks))
    n = F.col("n_comps")
    at = lambda k: F.min(F.when((F.col("side") == 1) & (F.col("run_n") > k), F.col("price")))
    stats = _join_groups(run, sizes).groupBy(*GROUP).agg(
        at(F.floor((n - 1) / 2)).alias("_low"), at(F.floor(n / 2)).alias("_high"), at(F.floor(n * F.lit(0.25))).alias("p25"), at(F.floor(n * F.lit(0.75))).alias("p75"), F.min(F.when(F.col("side") == 1, F.col("price"))).alias("cheapest"),
    )
    below = run.where("side = 0").select(*GROUP, F.col("price").alias("_own"), F.col("run_n").alias("below"))
    s = _join_groups(asked, stats).join(below.select(*[F.col(k).alias(f"_{k}") for k in GROUP], "_own", "below"), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in GROUP] + [F.col("own") == F.col("_own")]), "left")
    tier = F.col("tier")
    confidence = F.when((tier <= TIGHT) & (n >= HIGH_COMPS), "high").when((tier <= 3) & (n >= MIN_COMPS), "medium").otherwise("low")
    verdict = F.when(tier > TIGHT, "insufficient").when(F.col("cheapest") < F.col("own"), "flag").otherwise("pass")
    two = lambda c, name: F.round(c, 2).cast("double").alias(name)
    middle = (F.col("_low") + F.col("_high")) * F.lit(0.5).cast("decimal(2,1)" if dict(rows.dtypes)["price"].startswith("decimal") else "double")
    return s.select("id", "tier", "n_comps", two(middle, "median"), two(F.col("p25"), "p25"), two(F.col("p75"), "p75"), two(F.col("cheapest"), "cheapest"), F.round(F.coalesce("below", F.lit(0)) / n * 100.0, 1).alias("percentile"), confidence.alias("confidence"), verdict.alias("verdict"))


def market(rows: DataFrame, comps: DataFrame, near: DataFrame) -> DataFrame:
    """The ladder over new builds, then over all; the first (pass, tier) with enough gives the market's mean and band. The mean is rounded from the exact sum of decimals."""
    choices = cut(_grouped(_chosen_pass(tier_counts(rows, comps, near))))
    sums = members(choices, comps, near, *shares(choices)).groupBy(*GROUP).agg(F.sum(F.col("price").cast("decimal(18,4)") * F.col("n")).alias("total"))
    m = _join_groups(_with_choice(rows, choices), sums).withColumn("mean", F.col("total").cast("double") / F.col("n_comps"))
    variance = (F.col("price").cast("double") - F.col("mean")) / F.col("mean")
    cents = F.expr("(200 * total + n_comps) div (2 * n_comps)")  # half a cent goes up
    return m.select("id", (~F.col("only_new")).alias("established_used"), "tier", "n_comps", (cents / 100.0).alias("mean"), F.round(variance * 100, 2).alias("variance_pct"), band(variance, MARKET_BANDS, MARKET_TOP).alias("classification"))


# --- fixed values: bands of a price against the market's average, in percent ---
BELOW, COMPETITIVE, SLIGHTLY_ABOVE = -5.0, 5.0, 12.0


def market_average(found: DataFrame, rows: DataFrame) -> DataFrame:
    """id, comparables, average (whole), variance_pct, band and points for rows (id, price); found: id, comp_price of their comparables. Without comparables a row
    is unbenchmarked and gets neutral points."""
    m = found.groupBy("id").agg(F.count("comp_price").alias("comparables"), F.avg("comp_price").alias("mean"))
    j = rows.select("id", "price").join(m, "id", "left")
    off = (F.col("price") - F.col("mean")) / F.col("mean") * 100
    bands = ((off < BELOW, "Below Market Value", 15.0), (off <= COMPETITIVE, "Competitive Market Value", 12.5), (off <= SLIGHTLY_ABOVE, "Slightly Above Market", 10.0))
    band, points = F.lit("Poor Value"), F.lit(5.0)
    for test, name, worth in reversed(bands):
        band, points = F.when(test, name).otherwise(band), F.when(test, worth).otherwise(points)
    none = F.col("mean").isNull()
    return j.select(
        "id", F.coalesce("comparables", F.lit(0).cast("long")).alias("comparables"), F.round("mean", 0).alias("average"), F.round(off, 1).alias("variance_pct"),
        F.when(none, "Unbenchmarked").otherwise(band).alias("band"), F.when(none, 7.5).otherwise(points).alias("points"),
    )


def cap_estimates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Where estimates are over ESTIMATE_SHARE of a key's rows, only that share of them stays, the first in order."""
    sized = df.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("is_estimate").alias("_e"))
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(key, "is_estimate").orderBy(order)))
    return r.join(sized, key).where(~F.col("is_estimate") | (F.col("_e") / F.col("_n") <= ESTIMATE_SHARE) | (F.col("_r") <= F.floor(F.col("_n") * F.lit(ESTIMATE_SHARE)))).drop("_n", "_e", "_r")
