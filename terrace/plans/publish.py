"""Queries on what is published and what is asked for: completions, figures, the registry, providers of comparables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import suggest
from ..sources import providers, registry
from .catalogue import query as _query
from .listings import listings, table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


@query("""WITH p AS (SELECT DISTINCT p_brand AS suburb, unnest(['NSW', 'VIC']) AS state FROM part),
n AS (SELECT lower(suburb) AS s, home AS t, count(*) AS n FROM LISTINGS WHERE superseded_by = '' GROUP BY ALL),
h AS (SELECT p.*, coalesce(n.n, 0) AS listings FROM p LEFT JOIN n ON n.s = lower(p.suburb) AND n.t = p.state),
e AS (SELECT lower(substr(suburb, 1, k)) AS prefix, suburb, state, listings FROM (SELECT *, unnest(range(1, least(length(suburb), 8) + 1)) AS k FROM h))
SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY listings DESC, lower(suburb), suburb, state)::INT AS place, suburb, state, listings FROM e QUALIFY place <= 5""")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix's five places, those with most live listings first."""
    places = table(spark, sf_dir, "part").select(F.col("p_brand").alias("suburb")).distinct().withColumn("state", F.explode(F.array(F.lit("NSW"), F.lit("VIC"))))
    rows = listings(spark, sf_dir).select("suburb", F.col("home").alias("state"), "superseded_by")
    return suggest.completions(suggest.held(places, rows, F.col("superseded_by") == ""), 5, 8)


@query("""SELECT unnest(['total', 'named', 'builders', 'with_state', 'with_suburb']) AS key, unnest([count(*), count(product_type), count(DISTINCT product_type), count(home), count(suburb)]) AS n FROM LISTINGS
UNION ALL SELECT 'suburb_source: ' || CASE WHEN suburb IS NULL THEN 'none' WHEN home IS NULL THEN 'address' ELSE 'stated' END, count(*) FROM LISTINGS GROUP BY 1""")
def snapshot_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select(F.col("product_type").alias("builder_name"), F.col("home").alias("state"), "suburb", F.when(F.col("suburb").isNull(), None).when(F.col("home").isNull(), "address").otherwise("stated").alias("suburb_source"))
    return suggest.figures(rows, "suburb_source")


@query("""SELECT s_name AS builder, CASE WHEN s_suppkey % 2 = 0 THEN 'NSW/VIC' ELSE '' END AS states, CASE s_suppkey % 4 WHEN 0 THEN 'ask [contact detail removed] first' WHEN 1 THEN 'ring [contact detail removed]' WHEN 2 THEN '' ELSE 'lots of land' END AS notes, '' AS secrets FROM supplier WHERE s_suppkey % 5 > 0""")
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public registry of suppliers; who has no name is left out, and notes lose their addresses and phone numbers."""
    k = F.col("s_suppkey")
    notes = F.when(k % 4 == 0, "ask a.b@c.com.au first").when(k % 4 == 1, "ring 0412 345 678").when(k % 4 == 3, "lots of land")
    companies = table(spark, sf_dir, "supplier").select(F.when(k % 5 > 0, F.col("s_name")).otherwise(" ").alias("builder_name"), F.when(k % 2 == 0, F.array(F.lit("NSW"), F.lit("VIC"))).alias("states"), F.lit("Yes").alias("contract_available"), F.lit(None).cast("string").alias("agent_available"), F.lit("https://x").alias("portal_url"), notes.alias("notes"))
    rows = registry.public_rows(companies)
    return rows.select(F.col("c3").alias("builder"), F.col("c4").alias("states"), F.col("c10").alias("notes"), F.concat(*[F.col(f"c{i}") for i in registry.BLANK]).alias("secrets"))


@query("""WITH c AS (SELECT p_brand AS suburb, CASE p_size % 4 WHEN 0 THEN 'House' WHEN 1 THEN 'Duplex' WHEN 2 THEN 'Unit' ELSE 'Shed' END AS type, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 3 = 1 THEN 100.0 END AS lo, CASE WHEN p_partkey % 6 = 1 THEN 200.0 END AS hi FROM part),
k(kind, type) AS (VALUES ('package', 'House'), ('package', 'Duplex'), ('dwelling', 'Unit')), a AS (SELECT DISTINCT suburb, kind FROM c, k WHERE suburb <> 'Brand#11')
SELECT c.suburb, k.kind, count(*) AS found, count(*) FILTER (price IS NULL AND (lo IS NULL OR hi IS NULL)) AS withheld, count(*) FILTER (price IS NULL AND lo IS NOT NULL AND hi IS NOT NULL) AS estimates, min(CASE WHEN price IS NOT NULL THEN price WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 END)::DOUBLE AS cheapest FROM c JOIN k USING (type) JOIN a USING (suburb, kind) GROUP BY 1, 2""")
def provider_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider asked for every suburb but one: what it found, withheld and only gave a range for."""
    k, z, none = F.col("p_partkey"), F.col("p_size"), F.lit(None)
    stored = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("suburb"), F.lit("NSW").alias("state"), F.when(z % 4 == 0, "House").when(z % 4 == 1, "Duplex").when(z % 4 == 2, "Unit").otherwise("Shed").alias("type"), k.cast("string").alias("comp_id"), none.cast("int").alias("bedrooms"), none.cast("double").alias("land_sqm"),
        F.when(k % 3 == 0, F.col("p_retailprice")).alias("price"), F.when(k % 3 == 1, 100.0).alias("price_from"), F.when(k % 6 == 1, 200.0).alias("price_to"), F.lit(False).alias("is_new"),
    )
    asked = stored.where("suburb <> 'Brand#11'").select("suburb", "state").distinct().withColumn("kind", F.explode(F.array(F.lit("package"), F.lit("dwelling"))))
    found, counts = providers.comparables(providers.Stored(stored, {"package": ["House", "Duplex"], "dwelling": ["Unit"]}).search(asked))
    prices = found.groupBy("suburb", "kind").agg(F.count_if("is_estimate").alias("estimates"), F.min("price").alias("cheapest"))
    return counts.join(prices, ["suburb", "kind"], "left").select("suburb", "kind", "found", "withheld", F.coalesce("estimates", F.lit(0)).alias("estimates"), "cheapest")
