"""Queries of the interactive path: gates, comparables, scores, ranking, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, geo, ladder, score
from .catalogue import query as _query
from .listings import listings, table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)

# --- gates ---
_GATE_SQL = """
WITH g AS (SELECT *, CASE
  WHEN superseded_by <> '' THEN 'superseded' WHEN home IS NULL THEN 'state unknown' WHEN home NOT IN ('NSW', 'VIC') THEN 'other state'
  WHEN availability IS NULL THEN 'availability unstated' WHEN lower(trim(availability)) IN ('sold', 'under offer') THEN 'not available' WHEN lower(trim(availability)) NOT IN ('available') THEN 'availability unstated'
  WHEN price IS NULL OR price <= 0 THEN 'no price' WHEN price > 1500 + 500 THEN 'over ceiling' WHEN suburb IS NULL THEN 'no suburb'
  WHEN bedrooms IS NULL OR land_sqm IS NULL THEN 'incomplete' END AS gate_reason FROM LISTINGS)
"""
BRIEF = {"states": ["NSW", "VIC"], "budget": 1500.0, "slack": 500.0, "bedrooms_min": 3, "land_min": 200.0}


@query(_GATE_SQL + "SELECT coalesce(gate_reason, 'kept') AS gate_reason, count(*) AS n FROM g GROUP BY 1")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gates.gated(listings(spark, sf_dir), BRIEF)
    return g.groupBy(F.coalesce("gate_reason", F.lit("kept")).alias("gate_reason")).agg(F.count("*").alias("n"))


@query(_GATE_SQL + "SELECT id, price, home FROM g WHERE gate_reason IS NULL ORDER BY price, id LIMIT 600")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.gated(listings(spark, sf_dir), BRIEF).where("gate_reason IS NULL").orderBy("price", "id").limit(600).select("id", "price", "home")


@query(_GATE_SQL + "SELECT label, count(*) AS n FROM (SELECT unnest([CASE WHEN bedrooms IS NULL THEN 'bedrooms' END, CASE WHEN bathrooms IS NULL THEN 'bathrooms' END, CASE WHEN car_spaces IS NULL THEN 'car_spaces' END, CASE WHEN house_sqm IS NULL THEN 'house_sqm' END, CASE WHEN land_sqm IS NULL THEN 'land_sqm' END]) AS label FROM g WHERE gate_reason IS NULL OR gate_reason = 'incomplete') WHERE label IS NOT NULL GROUP BY 1")
def binding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that rows past the other gates leave out."""
    g = gates.gated(listings(spark, sf_dir), BRIEF).where("gate_reason IS NULL OR gate_reason = 'incomplete'")
    return g.select(F.explode(gates.missing(["bedrooms", "bathrooms", "car_spaces", "house_sqm", "land_sqm"])).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(_GATE_SQL + "SELECT count(*) AS total, count(*) FILTER (gate_reason IS NULL) AS kept, count(*) FILTER (gate_reason = 'over ceiling') AS over_ceiling, count(*) FILTER (gate_reason IS NULL AND (bathrooms IS NULL OR car_spaces IS NULL)) AS unstated_but_scored FROM g")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, kept = gates.gated(listings(spark, sf_dir), BRIEF), F.col("gate_reason").isNull()
    return g.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(F.col("gate_reason") == "over ceiling").alias("over_ceiling"), F.count_if(kept & (F.col("bathrooms").isNull() | F.col("car_spaces").isNull())).alias("unstated_but_scored"))


_WORDS = (*gates.ACCEPTED, *gates.REFUSED, "eoi", "sold out", " Now Selling ", "OFF MARKET", "mystery", "")


@query("WITH w AS (SELECT [" + ", ".join(f"'{w}'" for w in _WORDS) + f"""] AS said), l AS (SELECT p_partkey AS id, lower(trim(w.said[(p_partkey % {len(_WORDS)})::INT + 1])) AS said FROM part, w)
SELECT id, CASE WHEN said IN ('sold', 'under offer', 'reserved', 'leased', 'on hold', 'withdrawn', 'not available', 'unavailable', 'not avail', 'no longer available', 'off market', 'settled', 'deposit taken', 'contract pending') THEN 'not available'
  WHEN said NOT IN ('available', 'for sale', 'in stock', 'released', 'selling', 'titled', 'now selling', 'open') THEN 'availability unstated' END AS gate_reason FROM l""")
def gate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that states availability, and some that don't."""
    said = F.get(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % len(_WORDS)).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("").alias("superseded_by"), F.lit("NSW").alias("home"), said.alias("availability"), F.lit(1.0).alias("price"), F.lit("A").alias("suburb"))
    return gates.gated(rows, {"states": ["NSW"]}).select("id", "gate_reason")


@query("""WITH m AS (SELECT p_size, avg(p_retailprice) AS mean, count(*) AS n FROM part WHERE p_size % 7 > 0 GROUP BY 1), v AS (SELECT p_partkey AS id, n, mean, (p_retailprice - mean) / mean * 100 AS off FROM part LEFT JOIN m USING (p_size))
SELECT id, coalesce(n, 0) AS comparables, round(mean, 0) AS average, CASE WHEN off IS NULL THEN 'Unbenchmarked' WHEN off < -5 THEN 'Below Market Value' WHEN off <= 5 THEN 'Competitive Market Value' WHEN off <= 12 THEN 'Slightly Above Market' ELSE 'Poor Value' END AS band,
  CASE WHEN off IS NULL THEN 7.5 WHEN off < -5 THEN 15.0 WHEN off <= 5 THEN 12.5 WHEN off <= 12 THEN 10.0 ELSE 5.0 END::DOUBLE AS points FROM v""")
def market_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), "p_size")
    means = p.where("p_size % 7 > 0").groupBy("p_size").agg(F.avg("price").alias("comp_price"), F.count("*").alias("n"))
    # of each size the parts' average is the one comparable, so that sizes with many parts are summed before the join
    found = p.select("id", "p_size").join(means, "p_size").select("id", "comp_price", "n")
    out = ladder.market_average(found, p).drop("variance_pct", "comparables")
    return out.join(found.select("id", F.col("n").alias("comparables")), "id", "left").fillna(0, ["comparables"]).select("id", "comparables", "average", "band", "points")


# --- places ---
_PLACES_SQL = "places AS (SELECT n_nationkey AS id, n_name AS name, (n_nationkey * 37 % 60 - 30)::DOUBLE / 20 - 33 AS lat, (n_nationkey * 53 % 80)::DOUBLE / 20 + 149 AS lng, n_regionkey FROM nation)"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("id"), F.col("n_name").alias("name"), ((k * 37 % 60 - 30).cast("double") / 20 - 33).alias("lat"), ((k * 53 % 80).cast("double") / 20 + 149).alias("lng"), "n_regionkey")


@query(f"WITH {_PLACES_SQL} SELECT a.id AS a, b.id AS b, round({_KM.format(a='a', b='b')}, 1) AS km FROM places a JOIN places b ON a.n_regionkey = b.n_regionkey AND a.id < b.id")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    a, b = p.select(*[F.col(c).alias(f"a_{c}") for c in p.columns]), p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns])
    j = a.join(b, (F.col("a_n_regionkey") == F.col("b_n_regionkey")) & (F.col("a_id") < F.col("b_id")))
    return j.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(geo.km("a_", "b_"), 1).alias("km"))


@query(f"""WITH {_PLACES_SQL}, o AS (SELECT * FROM places WHERE id IN (3, 11)),
h AS (SELECT p.id, p.name, o.id AS origin, {_KM.format(a='o', b='p')} AS km FROM places p JOIN o ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, origin) AS r FROM h WHERE km <= 60)
SELECT id, name, origin, round(km, 1) AS km FROM r WHERE r = 1""")
def radius_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    out = geo.within_radius(p, p.where(F.col("id").isin(3, 11)), 60.0)
    return out.select("id", "name", "origin", F.round("km", 1).alias("km"))


@query(f"""WITH {_PLACES_SQL}, h AS (SELECT s.s_suppkey, {_KM.format(a='p', b='o')} AS km FROM supplier s JOIN places p ON p.id = s.s_nationkey JOIN places o ON o.id IN (3, 11))
SELECT s_suppkey, round(min(km), 1) AS km FROM h GROUP BY 1""")
def nearest_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places(spark, sf_dir)
    near = geo.within_radius(p, p.where(F.col("id").isin(3, 11)), None)
    return table(spark, sf_dir, "supplier").join(near, F.col("s_nationkey") == F.col("id"), "left").select("s_suppkey", F.round("km", 1).alias("km"))


# --- comparables ---
#: Prices as decimals: sums and middles of them are exact, so that half a cent is rounded alike by any engine.
PRICE = "decimal(18,4)"
_COMPS_SQL = """
comps AS (SELECT p_partkey AS comp_id, p_brand AS suburb, p_size % 3 + 2 AS bedrooms, CASE WHEN p_size % 6 = 0 THEN NULL ELSE (p_size * 20 + p_partkey % 13)::DOUBLE END AS land_sqm, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_retailprice * (10 + p_size % 17) / 10)::DECIMAL(18,4) END AS price,
  CASE p_size % 5 WHEN 0 THEN 'land_only' WHEN 1 THEN 'package' WHEN 2 THEN 'dwelling' ELSE 'unknown' END AS kind, p_partkey % 4 = 1 AS is_estimate, p_partkey % 3 = 0 AS is_new FROM part),
rows AS (SELECT id, suburb, bedrooms, land_sqm, price::DECIMAL(18,4) AS price, CASE product WHEN 'Land' THEN 'land_only' WHEN 'House & Land' THEN 'package' ELSE 'dwelling' END AS kind FROM LISTINGS WHERE product IN ('Land', 'House & Land', 'Apartment') AND suburb IS NOT NULL AND bedrooms IS NOT NULL),
near AS (SELECT a.n AS suburb, b.n AS other, abs(a.i - b.i) * 4.0::DOUBLE AS km FROM (SELECT DISTINCT p_brand AS n, substr(p_brand, 7)::INT AS i FROM part) a JOIN (SELECT DISTINCT p_brand AS n, substr(p_brand, 7)::INT AS i FROM part) b ON abs(a.i - b.i) * 4.0 <= 15),
tiers(tier, beds, land, km) AS (VALUES (1, 0, 0.15, 0.0), (2, 0, 0.30, 0.0), (3, 1, NULL, 0.0), (4, 0, NULL, 5.0), (5, 1, NULL, 15.0)),
pairs AS (SELECT r.id, t.tier, r.price AS own, c.comp_id, c.price, c.is_estimate, c.is_new FROM rows r JOIN near n ON n.suburb = r.suburb JOIN comps c ON c.suburb = n.other AND c.kind = r.kind AND c.price > 0 JOIN tiers t ON abs(c.bedrooms - r.bedrooms) <= t.beds AND n.km <= t.km
  AND (t.land IS NULL OR r.land_sqm IS NULL OR c.land_sqm BETWEEN r.land_sqm * (1 - t.land) AND r.land_sqm * (1 + t.land)))
"""


def _comparables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    kind = F.when(size % 5 == 0, "land_only").when(size % 5 == 1, "package").when(size % 5 == 2, "dwelling").otherwise("unknown")
    comps = p.select(
        key.alias("comp_id"), F.col("p_brand").alias("suburb"), (size % 3 + 2).alias("bedrooms"), F.when(size % 6 != 0, (size * 20 + key % 13).cast("double")).alias("land_sqm"),
        F.when(key % 9 != 0, (F.col("p_retailprice") * (10 + size % 17) / 10).cast(PRICE)).alias("price"), kind.alias("kind"), (key % 4 == 1).alias("is_estimate"), (key % 3 == 0).alias("is_new"),
    )
    product = F.col("product")
    rows = listings(spark, sf_dir)
    rows = rows.where(product.isin("Land", "House & Land", "Apartment") & F.col("suburb").isNotNull() & F.col("bedrooms").isNotNull())
    rows = rows.select("id", "suburb", "bedrooms", "land_sqm", F.col("price").cast(PRICE).alias("price"), F.when(product == "Land", "land_only").when(product == "House & Land", "package").otherwise("dwelling").alias("kind"))
    names = p.select(F.col("p_brand").alias("n")).distinct().withColumn("i", F.substring("n", 7, 9).cast("int"))
    other = names.select(F.col("n").alias("other"), F.col("i").alias("j"))
    near = names.join(F.broadcast(other), F.abs(F.col("i") - F.col("j")) * 4.0 <= 15).select(F.col("n").alias("suburb"), "other", (F.abs(F.col("i") - F.col("j")) * 4.0).alias("km"))
    return rows, comps, near


@query("WITH " + _COMPS_SQL + ", c AS (SELECT r.id, c.comp_id, n.km, abs(c.bedrooms - r.bedrooms) AS d, row_number() OVER (PARTITION BY r.id ORDER BY n.km, abs(c.bedrooms - r.bedrooms), c.comp_id) AS rank FROM rows r JOIN near n ON n.suburb = r.suburb JOIN comps c ON c.suburb = n.other AND c.price > 0 AND abs(c.bedrooms - r.bedrooms) <= 1) SELECT id, comp_id, km, rank::INT AS rank FROM c WHERE rank <= 5")
def comparables_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, comps, near = _comparables(spark, sf_dir)
    return ladder.nearest(rows, comps, near, 5).select("id", "comp_id", "km", "rank")


@query(ORACLE_SQL["comparables_topk"])
def comparables_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, comps, near = _comparables(spark, sf_dir)
    return ladder.nearest(rows, comps, near, 5).select("id", "comp_id", "km", "rank")


_LADDER_SQL = "WITH " + _COMPS_SQL + """,
n AS (SELECT r.id, t.tier, count(p.comp_id) AS n FROM rows r JOIN tiers t ON true LEFT JOIN pairs p ON p.id = r.id AND p.tier = t.tier GROUP BY 1, 2),
chosen AS (SELECT id, min(tier) AS tier FROM n WHERE n >= 8 OR tier = 5 GROUP BY 1),
picked AS (SELECT p.* FROM pairs p JOIN chosen c ON c.id = p.id AND c.tier = p.tier),
s AS (SELECT id, tier, count(*)::INT AS n_comps, list_sort(list(price)) AS p, min(price) AS cheapest, any_value(own) AS own, count(*) FILTER (price < own) AS below FROM picked GROUP BY 1, 2)
"""


@query(_LADDER_SQL + "SELECT c.id, c.tier, coalesce(n.n, 0)::INT AS n_comps FROM chosen c JOIN n ON n.id = c.id AND n.tier = c.tier")
def ladder_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.choose(*_comparables(spark, sf_dir))


@query(ORACLE_SQL["ladder_tier"])
def ladder_tier_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.choose(*_comparables(spark, sf_dir))


@query(_LADDER_SQL + "SELECT id, tier, n_comps, round((p[(n_comps - 1) // 2 + 1] + p[n_comps // 2 + 1]) * 0.5::DECIMAL(2,1), 2)::DOUBLE AS median, round(p[(floor(n_comps * 0.25))::INT + 1], 2)::DOUBLE AS p25, round(p[(floor(n_comps * 0.75))::INT + 1], 2)::DOUBLE AS p75, round(cheapest, 2)::DOUBLE AS cheapest, round(below / n_comps * 100.0, 1) AS percentile, CASE WHEN tier <= 2 AND n_comps >= 12 THEN 'high' WHEN tier <= 3 AND n_comps >= 8 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN tier > 2 THEN 'insufficient' WHEN cheapest < own THEN 'flag' ELSE 'pass' END AS verdict FROM s WHERE n_comps >= 4")
def competitive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, comps, near = _comparables(spark, sf_dir)
    return ladder.competitive(rows, comps, near)


@query(ORACLE_SQL["competitive_stats"])
def competitive_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, comps, near = _comparables(spark, sf_dir)
    return ladder.competitive(rows, comps, near)


@query("WITH " + _COMPS_SQL + """,
two AS (SELECT *, CASE WHEN is_new THEN 0 ELSE 1 END AS est FROM pairs),
passes AS (SELECT id, tier, 0 AS pass, price, own FROM two WHERE is_new UNION ALL SELECT id, tier, 1, price, own FROM two),
n AS (SELECT id, pass, tier, count(*)::INT AS n, sum(price) AS total, sum((price * 10000)::BIGINT) AS units, sum(price)::DOUBLE / count(*) AS mean, any_value(own)::DOUBLE AS own FROM passes GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass, tier) AS r FROM n WHERE n >= 8 OR (tier = 5 AND n >= 4))
SELECT id, pass = 1 AS established_used, tier, n AS n_comps, ((units + 50 * n) // (100 * n))::DOUBLE / 100.0 AS mean, round((own - mean) / mean * 100, 2) AS variance_pct, CASE WHEN (own - mean) / mean < -0.05 THEN 'Below Market Value' WHEN (own - mean) / mean < 0.05 THEN 'Competitive Market Value' WHEN (own - mean) / mean < 0.12 THEN 'Slightly Above Market' ELSE 'Poor Value' END AS classification FROM best WHERE r = 1""")
def market_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.market(*_comparables(spark, sf_dir))


@query(ORACLE_SQL["market_band"])
def market_band_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.market(*_comparables(spark, sf_dir))


@query("WITH e AS (SELECT p_brand, p_partkey, p_partkey % 4 <> 1 AS is_estimate, count(*) OVER (PARTITION BY p_brand) AS n, count(*) FILTER (p_partkey % 4 <> 1) OVER (PARTITION BY p_brand) AS est, row_number() OVER (PARTITION BY p_brand, p_partkey % 4 <> 1 ORDER BY p_partkey) AS r FROM part) SELECT p_brand, count(*) AS n FROM e WHERE NOT is_estimate OR est / n <= 0.3 OR r <= floor(n * 0.3) GROUP BY 1")
def estimate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a set with too many estimates, only three tenths of the set may be estimates, the first ones."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_partkey") % 4 != 1).alias("is_estimate"))
    return ladder.cap_estimates(p, "p_brand", "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))


# --- scores ---
_SCORE_SQL = """
WITH c AS (SELECT o_orderkey AS id, o_totalprice AS advertised, o_orderkey % 3 = 0 AS site_fixed, o_orderkey % 5 <> 0 AS stated, o_orderkey % 7 = 0 AS no_driveway, o_orderkey % 11 = 0 AS no_fencing, o_orderkey % 4 = 0 AS no_flooring,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 5 + 1)::INT END AS bedrooms, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE (o_orderkey % 3 + 1)::DOUBLE END AS bathrooms, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 3)::INT END AS car_spaces,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (120 + o_orderkey % 150)::DOUBLE END AS house_sqm, CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE (200 + o_orderkey % 500)::DOUBLE END AS land_sqm, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE (o_orderkey % 3 + 1)::INT END AS storeys,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 60)::DOUBLE END AS km, o_orderkey % 17 = 0 AS in_primary, CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS builder, (o_orderkey % 19 = 0)::INT AS high_risks, (o_orderkey % 3)::INT AS medium_risks,
  CASE o_orderkey % 5 WHEN 0 THEN 15.0 WHEN 1 THEN 12.5 WHEN 2 THEN 10.0 WHEN 3 THEN 5.0 END AS value_points, (400 + o_orderkey % 300)::DOUBLE AS rent, CASE o_orderkey % 23 WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'Pending' ELSE 'Verified' END AS verification FROM orders),
a AS (SELECT *, CASE WHEN NOT site_fixed OR NOT stated THEN 15000 ELSE 0 END + CASE WHEN stated AND no_driveway THEN 5000 ELSE 0 END + CASE WHEN stated AND no_fencing THEN 4000 ELSE 0 END + CASE WHEN stated AND no_flooring THEN 6000 ELSE 0 END AS extras,
  (NOT site_fixed OR NOT stated)::INT + (stated AND no_driveway)::INT + (stated AND no_fencing)::INT + (stated AND no_flooring)::INT AS n_missing FROM c),
b AS (SELECT *, advertised + extras AS realistic, CASE WHEN NOT stated THEN 'Unclear' WHEN n_missing = 0 AND site_fixed THEN 'Full Turnkey' WHEN n_missing <= 2 THEN 'Partial Turnkey' ELSE 'Base Package' END AS turnkey FROM a),
s AS (SELECT *, advertised > 300000 OR coalesce(bedrooms < 3, false) OR coalesce(bathrooms < 2, false) OR coalesce(car_spaces < 1, false) OR coalesce(storeys > 2, false) OR km IS NULL OR km > 40 OR coalesce(house_sqm < 150, false) OR coalesce(land_sqm < 300, false) AS rejected,
  CASE WHEN advertised > 300000 THEN 0.0 WHEN realistic <= 250000 THEN 20.0 ELSE 10 + 10 * greatest(0.0, least(1.0, (300000 - realistic) / 50000)) END AS budget_fit,
  greatest(0.0, 20 - CASE WHEN bedrooms IS NULL THEN 1 WHEN bedrooms < 3 THEN 10 ELSE 0 END - CASE WHEN bathrooms IS NULL THEN 1 WHEN bathrooms < 2 THEN 5 ELSE 0 END - CASE WHEN car_spaces IS NULL THEN 1 WHEN car_spaces < 1 THEN 5 ELSE 0 END
    - CASE WHEN house_sqm IS NULL THEN 1 WHEN house_sqm < 150 THEN 5 ELSE 0 END - CASE WHEN land_sqm IS NULL THEN 1 WHEN land_sqm < 300 THEN 5 ELSE 0 END) AS requirement_match,
  greatest(0.0, least(15.0, coalesce(value_points, 7.5) - CASE WHEN extras > 15000 THEN 2.5 ELSE 0 END)) AS value_score,
  greatest(0.0, 15 - CASE WHEN in_primary THEN 0 WHEN km IS NULL THEN 4 ELSE least(6.0, round(km * 0.3, 1)) END) AS location_score, CASE builder WHEN 'HIGH' THEN 10.0 WHEN 'MEDIUM' THEN 7.0 ELSE 4.0 END AS builder_score,
  greatest(0.0, 10 - greatest(0.0, least(5.0, (8.0 - rent * 52 / realistic * 100) * 2.5))) AS rental_fit, greatest(0.0, 10.0 - 5 * high_risks - 2 * medium_risks) AS risk_score FROM b),
t AS (SELECT *, budget_fit + requirement_match + value_score + location_score + builder_score + rental_fit + risk_score AS total FROM s),
r AS (SELECT *, CASE WHEN verification = 'Pending' THEN 'Hold' WHEN verification = 'Unavailable' OR rejected THEN 'Do Not Recommend' WHEN total >= 80 AND high_risks = 0 THEN 'Recommend' WHEN total >= 65 THEN 'Recommend with Conditions' ELSE 'Hold' END AS recommendation FROM t)
"""
SCORE_BRIEF = score.Brief(budget_max=300_000.0, preferred_cap=250_000.0, bedrooms_min=3, bathrooms_min=2, car_spaces_min=1, house_min=150.0, land_min=300.0, storeys_max=2, radius_km=40.0, target_yield=8.0)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    gap = lambda mod, v: F.when(k % mod != 0, v)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_totalprice").alias("advertised"), (k % 3 == 0).alias("site_fixed"), (k % 5 != 0).alias("stated"), *[(k % m == 0).alias(n) for n, m in (("no_driveway", 7), ("no_fencing", 11), ("no_flooring", 4))],
        gap(6, (k % 5 + 1).cast("int")).alias("bedrooms"), gap(8, (k % 3 + 1).cast("double")).alias("bathrooms"), gap(9, (k % 3).cast("int")).alias("car_spaces"), gap(10, (120 + k % 150).cast("double")).alias("house_sqm"),
        gap(12, (200 + k % 500).cast("double")).alias("land_sqm"), gap(2, (k % 3 + 1).cast("int")).alias("storeys"), gap(13, (k % 60).cast("double")).alias("km"), (k % 17 == 0).alias("in_primary"),
        F.when(k % 4 == 0, "HIGH").when(k % 4 == 1, "MEDIUM").otherwise("LOW").alias("builder"), (k % 19 == 0).cast("int").alias("high_risks"), (k % 3).cast("int").alias("medium_risks"),
        F.when(k % 5 == 0, 15.0).when(k % 5 == 1, 12.5).when(k % 5 == 2, 10.0).when(k % 5 == 3, 5.0).alias("value_points"), (400 + k % 300).cast("double").alias("rent"),
        F.when(k % 23 == 0, "Unavailable").when(k % 23 == 1, "Pending").otherwise("Verified").alias("verification"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(_candidates(spark, sf_dir), SCORE_BRIEF)


@query(_SCORE_SQL + "SELECT id, extras::DOUBLE AS extras, realistic, turnkey FROM b")
def turnkey_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.turnkey(_candidates(spark, sf_dir)).select("id", "extras", "realistic", "turnkey")


@query(_SCORE_SQL + "SELECT id, round(budget_fit, 3) AS budget_fit, requirement_match::DOUBLE AS requirement_match, value_score::DOUBLE AS value_score, round(location_score, 3)::DOUBLE AS location_score, builder_score::DOUBLE AS builder_score, round(rental_fit, 3) AS rental_fit, risk_score::DOUBLE AS risk_score, rejected FROM t")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.round(c, 3).alias(c) if c in ("budget_fit", "location_score", "rental_fit") else F.col(c) for c in score.PARTS]
    return _scored(spark, sf_dir).select("id", *parts, "rejected")


@query(_SCORE_SQL + "SELECT id, round(total, 3) AS total FROM t")
def score_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.round("total", 3).alias("total"))


@query(_SCORE_SQL + "SELECT recommendation, count(*) AS n FROM r GROUP BY 1")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.recommended(_scored(spark, sf_dir)).groupBy("recommendation").agg(F.count("*").alias("n"))


_TOP_SQL = _SCORE_SQL + ", top AS (SELECT *, row_number() OVER (ORDER BY total DESC, id) AS rank FROM r WHERE verification = 'Verified' AND NOT rejected QUALIFY rank <= 5)"


@query(_TOP_SQL + "SELECT rank::INT AS rank, id, round(total, 3) AS total FROM top")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.shortlist(score.recommended(_scored(spark, sf_dir)), 5).select("rank", "id", F.round("total", 3).alias("total"))


@query(_TOP_SQL + "SELECT a.id AS a, b.id AS b, round(a.total - b.total, 3) AS lead, (a.realistic < b.realistic) AS cheaper FROM top a JOIN top b ON a.rank < b.rank")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a shortlist of five."""
    return score.pairwise(score.shortlist(score.recommended(_scored(spark, sf_dir)), 5))


@query(_TOP_SQL + ", f AS (SELECT id, unnest([CASE WHEN km IS NULL THEN 'no distance' END, CASE WHEN turnkey <> 'Full Turnkey' THEN 'extras to confirm' END, CASE WHEN bedrooms IS NULL THEN 'no bedrooms' END, CASE WHEN high_risks > 0 THEN 'high risk' END]) AS failure FROM top) SELECT id, failure FROM f WHERE failure IS NOT NULL")
def qa_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = score.shortlist(score.recommended(_scored(spark, sf_dir)), 5)
    return top.select("id", F.explode(score.failures()).alias("failure"))
