"""Queries on the catalogue: peers, captures, gates, cohorts, exports. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import band, content_hash, is_live, land_band, price_kind
from ..operators import captures, peers
from .listings import LISTINGS_DUCK, listings, relation, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, queries: dict | None = None, sqls: dict | None = None):
    """Registers a function under its name, with its SQL. In it, LISTINGS stands for the listing relation."""
    queries, sqls = (QUERIES, ORACLE_SQL) if queries is None else (queries, sqls)

    def add(f):
        queries[f.__name__] = f
        if sql:
            sqls[f.__name__] = sql.replace("LISTINGS", f"({LISTINGS_DUCK})")
        return f

    return add


# --- peers ---
_TIERS_SQL = """
WITH l AS (SELECT * FROM LISTINGS),
a AS (SELECT *, CASE WHEN suburb IS NULL OR product_type IS NULL OR bedrooms IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY suburb, product_type, bedrooms) END AS n1 FROM l),
b AS (SELECT *, CASE WHEN suburb IS NULL OR product_type IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY suburb, product_type) END AS n2 FROM a WHERE n1 < 6),
c AS (SELECT *, CASE WHEN suburb IS NULL OR bedrooms IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY suburb, bedrooms) END AS n3 FROM b WHERE n2 < 6),
placed AS (
  SELECT id, price, 1 AS tier, concat_ws('|', '1', state, suburb, product_type, bedrooms) AS grp, state, suburb, product_type, bedrooms FROM a WHERE n1 >= 6
  UNION ALL SELECT id, price, 2, concat_ws('|', '2', state, suburb, product_type), state, suburb, product_type, bedrooms FROM b WHERE n2 >= 6
  UNION ALL SELECT id, price, 3, concat_ws('|', '3', state, suburb, bedrooms), state, suburb, product_type, bedrooms FROM c WHERE n3 >= 6
),
spread AS (
  SELECT grp, len(p)::INT AS n, p[least(len(p) - 1, floor(len(p) * 0.9)::INT) + 1] / greatest(1.0, p[floor(len(p) * 0.1)::INT + 1]) AS spread
  FROM (SELECT grp, list_sort(list(price)) AS p FROM placed GROUP BY grp)
),
bench AS (
  SELECT x.id, x.tier, (count(*))::INT AS n_peers, median(y.price) AS median, any_value(x.price) AS price
  FROM placed x JOIN placed y ON x.grp = y.grp AND x.id <> y.id JOIN spread s ON s.grp = x.grp AND s.spread <= 2.5 GROUP BY x.id, x.tier
),
banded AS (
  SELECT *, (price - median) / median * 100 AS variance_pct, CASE WHEN (price - median) / median * 100 < -10 THEN 'Below comparable stock' WHEN (price - median) / median * 100 < -2.5 THEN 'Slightly below comparable stock'
    WHEN (price - median) / median * 100 < 2.5 THEN 'In line with comparable stock' WHEN (price - median) / median * 100 < 10 THEN 'Above comparable stock' ELSE 'Well above comparable stock' END AS classification FROM bench
)
"""


@query(_TIERS_SQL + "SELECT l.id, p.tier FROM l LEFT JOIN placed p ON l.id = p.id")
def peer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.assign_tiers(listings(spark, sf_dir)).select("id", "tier")


@query(_TIERS_SQL + "SELECT grp, n, round(spread, 6) AS spread FROM spread")
def peer_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.dispersions(listings(spark, sf_dir)).select("grp", "n", F.round("spread", 6).alias("spread"))


@query(_TIERS_SQL + "SELECT id, tier, n_peers, round(median, 4) AS median FROM banded")
def peer_loo_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.benchmark(listings(spark, sf_dir)).select("id", "tier", "n_peers", F.round("median", 4).alias("median"))


@query(_TIERS_SQL + "SELECT tier, classification, count(*) AS n FROM banded GROUP BY ALL")
def peer_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peers.benchmark(listings(spark, sf_dir)).groupBy("tier", "classification").agg(F.count("*").alias("n"))


@query(_TIERS_SQL + "SELECT id, tier, round(variance_pct, 4) AS variance_pct, classification FROM banded WHERE id IN (SELECT id FROM LISTINGS WHERE coalesce(superseded_by, '') = '') ORDER BY banded.variance_pct, id LIMIT 50")
def peer_best_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the catalogue benchmarked against its peers, the best-value live rows first (a top-k report)."""
    out = peers.benchmark(listings(spark, sf_dir)).where(is_live(F.col("superseded_by")))
    return out.orderBy("variance_pct", "id").limit(50).select("id", "tier", F.round("variance_pct", 4).alias("variance_pct"), "classification")


# --- captures ---
def _captures(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    # an id that depends on content alone; equal rows are told apart by their place among equals
    t = table(spark, sf_dir, "lineitem")
    if dealt:  # rows of a line lie together, for the numbering and for what is done by line
        t = t.repartition("l_orderkey", "l_linenumber")
    w = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax)"
    return t.withColumn("id", F.format_string("%08d-%02d-%08d-%06d-%04d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(w)))


_CAPTURES_SQL = """
WITH RECURSIVE cap AS (
  SELECT *, printf('%08d-%02d-%08d-%06d-%04d', l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax)) AS id FROM lineitem
),
one AS (SELECT id, w AS winner FROM (SELECT id, first_value(id) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, id DESC) AS w FROM cap) WHERE id <> w),
two AS (SELECT id, w AS winner FROM (SELECT id, first_value(id) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, id DESC) AS w FROM cap) WHERE id <> w AND id NOT IN (SELECT id FROM one)),
edge AS (SELECT * FROM one UNION ALL SELECT * FROM two),
walk(id, dst) AS (SELECT id, winner FROM edge UNION ALL SELECT walk.id, edge.winner FROM walk JOIN edge ON walk.dst = edge.id),
survivor AS (SELECT id, dst AS survivor FROM walk WHERE dst NOT IN (SELECT id FROM edge))
"""


@query(_CAPTURES_SQL + "SELECT id, winner FROM one")
def supersede_same_lot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.losers(_captures(spark, sf_dir), ["l_partkey", "l_suppkey"], ["l_shipdate"])


@query(_CAPTURES_SQL + "SELECT id, survivor FROM survivor")
def supersede_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.supersede(_captures(spark, sf_dir, dealt=True), ["l_partkey", "l_suppkey"], ["l_partkey"], ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query(_CAPTURES_SQL + "SELECT l_returnflag, count(*) AS n FROM cap WHERE id NOT IN (SELECT id FROM survivor) GROUP BY 1")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = supersede_survivor(spark, sf_dir)
    return _captures(spark, sf_dir, dealt=True).join(gone.select("id"), "id", "left_anti").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT id, 'v2:' || sha256('channel=' || CASE id % 3 WHEN 0 THEN 'portal' WHEN 1 THEN 'email' ELSE '' END || '|suburb=' || coalesce(lower(suburb), '') || '|product=' || coalesce(lower(product_type), '') || '|beds=' || coalesce(bedrooms::VARCHAR, '') || CASE WHEN id % 5 > 0 THEN '|variant_ordinal=' || (id % 5) ELSE '' END) AS content_hash FROM LISTINGS")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.when(F.col("id") % 3 == 0, " Portal").when(F.col("id") % 3 == 1, "email  ").otherwise("")
    parts = {"channel": channel, "suburb": F.col("suburb"), "product": F.col("product_type"), "beds": F.col("bedrooms").cast("string")}
    return listings(spark, sf_dir).select("id", content_hash(parts, F.col("id") % 5).alias("content_hash"))


@query("""
WITH c AS (SELECT *, printf('%08d-%02d-%08d-%06d-%04d', l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax)) AS id FROM lineitem),
f AS (SELECT id, l_orderkey, min(id) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) AS f FROM c)
SELECT id, (dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f) - 1)::INT AS variant_ordinal FROM f""")
def variant_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.variant_ordinals(_captures(spark, sf_dir), "l_orderkey", ["l_returnflag", "l_linestatus"], "id").select("id", "variant_ordinal")


@query("SELECT l_partkey, l_returnflag, min(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY 1, 2")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _captures(spark, sf_dir)
    kept = captures.first_by(c, ["l_partkey", "l_returnflag"], [F.col("l_extendedprice"), F.col("id")])
    n = c.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    return kept.select("l_partkey", "l_returnflag", F.col("l_extendedprice").alias("price")).join(n, ["l_partkey", "l_returnflag"])


@query("""SELECT id, lot, design, price FROM (SELECT id, coalesce(suburb, '') AS lot, coalesce(lower(product_type), '') AS design, price, row_number() OVER (PARTITION BY coalesce(lower(suburb), ''), coalesce(lower(product_type), ''), price ORDER BY id) AS r FROM LISTINGS) WHERE r = 1""")
def package_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lot, design and price equal: the first is kept."""
    l = listings(spark, sf_dir)
    keyed = l.select("id", F.coalesce("suburb", F.lit("")).alias("lot"), F.coalesce(F.lower("product_type"), F.lit("")).alias("design"), "price", F.lower(F.coalesce("suburb", F.lit(""))).alias("k"), F.col("price").alias("p"))
    return captures.first_by(keyed, ["k", "design", "p"], [F.col("id")]).select("id", "lot", "design", "price")


@query("""WITH k AS (SELECT *, min(id) OVER (PARTITION BY suburb, bedrooms, bathrooms, car_spaces) AS first_row, row_number() OVER (PARTITION BY suburb, bedrooms, bathrooms, car_spaces ORDER BY price DESC, (product_type IS NOT NULL) DESC, id) AS r FROM LISTINGS)
SELECT id, first_row FROM k WHERE r = 1""")
def same_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("price").desc(), F.col("product_type").isNotNull().desc(), F.col("id")]
    return captures.same_listing(listings(spark, sf_dir), ["suburb", "bedrooms", "bathrooms", "car_spaces"], order, "id").select("id", "first_row")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").withColumn("half", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    pick = lambda h: captures.first_by(o.where(F.col("half") == h), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select(
        "o_custkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("detail"), F.col("o_orderdate").alias("last_seen")
    )
    return pick(True).withColumn("price_previous", F.lit(None).cast("double")), pick(False).withColumn("price_previous", F.lit(None).cast("double"))


_MERGE_SQL = """
WITH o AS (SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS half, row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
s AS (SELECT half, o_custkey, o_totalprice AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS detail, o_orderdate AS last_seen FROM o WHERE r = 1),
m AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.price AS ap, b.price AS bp, a.status AS s1, b.status AS s2, a.detail AS d1, b.detail AS d2, a.last_seen AS l1, b.last_seen AS l2, a.o_custkey IS NOT NULL AS was, b.o_custkey IS NOT NULL AS now
  FROM (SELECT * FROM s WHERE half) a FULL JOIN (SELECT * FROM s WHERE NOT half) b ON a.o_custkey = b.o_custkey),
v AS (SELECT *, was AND now AND (bp IS DISTINCT FROM ap OR (coalesce(s2, '') <> '' AND s2 IS DISTINCT FROM s1) OR (coalesce(d1, '') = '' AND coalesce(d2, '') <> '' )) AS changed FROM m)
SELECT o_custkey, CASE WHEN now THEN bp ELSE ap END AS price, CASE WHEN was AND now AND ap <> bp THEN ap END AS price_previous, CASE WHEN was AND now THEN CASE WHEN coalesce(s2, '') <> '' THEN s2 ELSE s1 END WHEN was THEN s1 ELSE s2 END AS status,
  CASE WHEN was AND now THEN CASE WHEN coalesce(d1, '') = '' AND coalesce(d2, '') <> '' THEN d2 ELSE d1 END WHEN was THEN d1 ELSE d2 END AS detail, CASE WHEN now THEN l2 ELSE l1 END AS last_seen,
  CASE WHEN NOT was THEN 'new' WHEN NOT now THEN 'kept' WHEN changed THEN 'updated' ELSE 'unchanged' END AS outcome FROM v
"""


@query(_MERGE_SQL)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    rules = {"price": captures.STATED, "status": captures.STATED, "detail": captures.FILL, "last_seen": captures.ALWAYS}
    return captures.merge(old, new, "o_custkey", rules, {"price": "price_previous"})


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, any_value(c_name) FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return captures.insert_absent(s, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k")


# --- bands, kinds, cohorts ---
@query("SELECT id, CASE WHEN land_sqm IS NULL OR land_sqm <= 0 THEN NULL WHEN land_sqm < 300 THEN '0-300' WHEN land_sqm < 450 THEN '300-450' WHEN land_sqm < 600 THEN '450-600' WHEN land_sqm < 800 THEN '600-800' WHEN land_sqm < 1000 THEN '800-1000' ELSE '1000+' END AS land_band FROM LISTINGS")
def land_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("id", land_band(F.col("land_sqm")).alias("land_band"))


_KIND_SQL = """WITH k AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'land_only' WHEN id % 17 = 0 THEN 'build_only' WHEN product = 'Land' THEN 'land_only' WHEN product = 'House & Land' THEN 'package' WHEN product = 'Apartment' THEN 'dwelling' WHEN product = 'Commercial' THEN 'commercial'
  WHEN id % 2 = 0 THEN 'package' ELSE 'unknown' END AS kind, CASE WHEN land_sqm IS NULL THEN NULL WHEN land_sqm < 300 THEN '0-300' WHEN land_sqm < 450 THEN '300-450' WHEN land_sqm < 600 THEN '450-600' WHEN land_sqm < 800 THEN '600-800' WHEN land_sqm < 1000 THEN '800-1000' ELSE '1000+' END AS band FROM LISTINGS),
s AS (SELECT *, CASE WHEN kind = 'unknown' THEN 'kind not recorded' WHEN kind NOT IN ('package', 'dwelling', 'land_only') THEN 'kind has no comparable' WHEN suburb IS NULL THEN 'no suburb' WHEN home IS NULL THEN 'no state' WHEN bedrooms IS NULL THEN 'no bedrooms' WHEN band IS NULL AND kind <> 'dwelling' THEN 'no land size' END AS skipped FROM k)
"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("id") % 13 == 0, "Vacant  land, registered soon").when(F.col("id") % 17 == 0, "House only").otherwise("4 bed home")
    land = F.when(F.col("id") % 2 == 0, F.col("price") * 0.4)
    l = listings(spark, sf_dir)
    return l.withColumn("kind", price_kind(text, F.col("product"), land, F.col("price") - land, F.col("price"))["kind"])


@query(_KIND_SQL + "SELECT kind, count(*) AS n FROM k GROUP BY 1")
def price_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def cohort_columns(df: DataFrame) -> DataFrame:
    """land_band (n/a for a dwelling without land) and ``skipped``: why a row has no cohort."""
    banded = land_band(F.col("land_sqm"))
    skip = (
        F.when(F.col("kind") == "unknown", "kind not recorded").when(~F.col("kind").isin("package", "dwelling", "land_only"), "kind has no comparable").when(F.col("suburb").isNull(), "no suburb")
        .when(F.col("home").isNull(), "no state").when(F.col("bedrooms").isNull(), "no bedrooms").when(banded.isNull() & (F.col("kind") != "dwelling"), "no land size")
    )
    return df.withColumn("land_band", F.coalesce(banded, F.when(F.col("kind") == "dwelling", "n/a"))).withColumn("skipped", skip)


@query(_KIND_SQL + "SELECT suburb, home, kind, bedrooms, coalesce(band, 'n/a') AS land_band, count(*) AS n, round(sum(price), 2) AS total FROM s WHERE skipped IS NULL GROUP BY ALL")
def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cohort_columns(_kinds(spark, sf_dir)).where("skipped IS NULL")
    return c.groupBy("suburb", "home", "kind", "bedrooms", "land_band").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(_KIND_SQL + "SELECT skipped, count(*) AS n FROM s WHERE skipped IS NOT NULL GROUP BY 1")
def cohort_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_columns(_kinds(spark, sf_dir)).where("skipped IS NOT NULL").groupBy("skipped").agg(F.count("*").alias("n"))


@query(_KIND_SQL + "SELECT suburb, home, kind, bedrooms, coalesce(band, 'n/a') AS land_band, count(*) AS n FROM s WHERE skipped IS NULL GROUP BY ALL ORDER BY n DESC, suburb, home, kind, bedrooms, land_band LIMIT 5")
def largest_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["suburb", "home", "kind", "bedrooms", "land_band"]
    return cohorts(spark, sf_dir).select(*keys, "n").orderBy(F.col("n").desc(), *keys).limit(5)


@query(_KIND_SQL + """, v AS (SELECT suburb, home, kind, bedrooms, coalesce(band, 'n/a') AS b, CASE WHEN count(*) < 2 THEN 'insufficient' WHEN min(price) * 1.2 < avg(price) THEN 'flag' ELSE 'pass' END AS verdict FROM s WHERE skipped IS NULL GROUP BY ALL)
SELECT s.suburb, count(*) FILTER (verdict = 'flag') AS flag, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'insufficient') AS insufficient FROM s JOIN v ON s.suburb = v.suburb AND s.home = v.home AND s.kind = v.kind AND s.bedrooms = v.bedrooms AND coalesce(s.band, 'n/a') = v.b WHERE skipped IS NULL GROUP BY 1""")
def exposure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict per cohort, fanned out to its listings, rolled up by locality."""
    keys = ["suburb", "home", "kind", "bedrooms", "land_band"]
    c = cohort_columns(_kinds(spark, sf_dir)).where("skipped IS NULL")
    verdict = F.when(F.count("*") < 2, "insufficient").when(F.min("price") * 1.2 < F.avg("price"), "flag").otherwise("pass")
    v = c.groupBy(*keys).agg(verdict.alias("verdict"))
    return c.join(v, keys).groupBy("suburb").agg(*[F.count_if(F.col("verdict") == x).alias(x) for x in ("flag", "pass", "insufficient")])
