"""Queries on audits of stored rows and on the small steps around a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listing
from ..operators import audits
from .catalogue import query as _query
from .lines import _k, _money, _part, _say, _z
from .listings import listings, table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


@query("SELECT p_partkey AS id, '2226' AS postcode, p_partkey % 2 = 0 AS drop_state FROM part WHERE p_size % 3 <> 1")
def fabricated_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("2226 Whiterock White Rock 156 Facade A", "Lot 5 Austral 2226", "Lot 9 Austral 2765")
    rows = _part(spark, sf_dir).select(_k().alias("id"), F.lit("2226").alias("postcode"), F.lit("").alias("lot_address"), F.lit(None).cast("string").alias("suburb"), line.alias("source_text"), F.lit("NSW").alias("state"), F.when(_k() % 2 == 0, " Postcode").otherwise("suburb").alias("state_source"))
    return audits.fabricated_postcodes(rows)


@query("SELECT p_partkey AS id, 535000 + p_size AS price, (900000 + p_partkey % 99 * 1000 + 900)::DOUBLE AS total, 397900.0::DOUBLE AS land, 535000.0::DOUBLE AS build FROM part WHERE p_size % 2 = 0")
def understated_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundreds = F.lpad((_k() % 99).cast("string"), 2, "0")
    line = F.when(_z() % 2 == 0, F.concat(F.lit("4 2 1 272 $ 397,900 $ 535,000 $ 9 "), hundreds, F.lit(",900 Split"))).otherwise(F.concat(F.lit("$397,900 $535,000 $"), _money(932900 + _k() % 9)))
    return audits.understated_prices(_part(spark, sf_dir).select(_k().alias("id"), (535000 + _z()).alias("price"), line.alias("source_text")))


@query("SELECT id FROM LISTINGS WHERE product = '' AND NOT (id % 3 = 0 AND bedrooms IS NOT NULL) AND NOT (id % 7 = 0 AND house_sqm IS NOT NULL) AND land_sqm IS NOT NULL AND (id % 2 = 0 OR id % 5 = 1)")
def land_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir).withColumns({"product_type": F.col("product"), "bedrooms": F.when(F.col("id") % 3 == 0, F.col("bedrooms")), "house_sqm": F.when(F.col("id") % 7 == 0, F.col("house_sqm")), "estate_name": F.when(F.col("id") % 2 == 0, "Box Hill LAND ONLY (10/27)"), "source_text": F.when(F.col("id") % 5 == 1, "vacant  land by the lake").otherwise("a vacant landing")})
    return audits.land_only(l)


@query("""WITH r AS (SELECT *, id % 3 <> 2 AS said, CASE id % 3 WHEN 0 THEN 4 ELSE 3 END AS b FROM LISTINGS) SELECT count(bedrooms) AS bedrooms_before, count(CASE WHEN said THEN coalesce(bedrooms, b) ELSE bedrooms END) AS bedrooms_after, count(bathrooms) AS bathrooms_before, count(CASE WHEN said THEN coalesce(bathrooms, 2) ELSE bathrooms END) AS bathrooms_after,
count(car_spaces) AS car_spaces_before, count(CASE WHEN said THEN coalesce(car_spaces, 1) ELSE car_spaces END) AS car_spaces_after, count_if(said AND bedrooms = b) AS agree, count_if(said AND bedrooms <> b) AS disagree FROM r""")
def spec_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return audits.spec_audit(listings(spark, sf_dir).withColumns({"source_text": F.when(i % 3 == 0, "4 beds / 2 baths / 1 car").when(i % 3 == 2, "nothing said"), "lot_address": F.lit("3x2x1 Lot 14")}))


@query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'a column header' WHEN 1 THEN 'no price' WHEN 2 THEN 'a fragment of prices' WHEN 3 THEN 'a wall of prices' END AS reason FROM part WHERE p_size % 6 < 4")
def rejected_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = "Summary of commercial $1,300,000 $1,250,000 $1,250,000 $1,200,000 $1,100,000"
    line = _say("Lot Land Size Price Estate Name", "Aberdeen at the lake", "Land $714,900", wall, F.concat(F.lit("Lot 7 "), F.lit(wall)), "")
    return audits.rejected_today(_part(spark, sf_dir).select(_k().alias("id"), line.alias("source_text")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 4 * 10)::VARCHAR END AS lot, CASE p_size % 5 WHEN 0 THEN 'Denmark 185 Scullery Brochure' WHEN 1 THEN 'Coastal Range' WHEN 2 THEN 'Sq Range' WHEN 3 THEN 'brochure' ELSE 'Untitled document' END AS title, CASE p_size % 4 WHEN 0 THEN 'Wilton' WHEN 1 THEN 'Victoria' WHEN 2 THEN 'Austral' ELSE 'qld' END AS suburb FROM part")
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    lot = F.concat(F.lpad((_k() % 4 * 10).cast("string"), 8, "0"), F.lit("/00000014"))
    title = _say("Icon to represent a brochure", " Coastal\nRange - Download Brochure", "Download", "brochure", "")
    url = _say("https://x.au/f/Denmark-185-Scullery-Brochure.pdf?a=1", "https://x.au/a.pdf", "https://x.au/20240101-sq_range-final.pdf/", "https://x.au/12.pdf", "")
    suburb, address = _say("New South Wales", "Victoria", " Austral ", "qld"), _say("Lot 3, BINGARA DRIVE, WILTON, New South Wales, 2571", "12 High Street, VIC", "x, y", "Town")
    return _part(spark, sf_dir).select(_k().alias("id"), listing.bare_lot(F.when(_k() % 4 == 0, "0000/1").otherwise(lot)).alias("lot"), listing.document_title(title, url).alias("title"), listing.display_suburb(suburb, address).alias("suburb"))


@query("WITH f AS (SELECT p_brand AS k, min(p_partkey) AS o FROM part GROUP BY 1) SELECT p_partkey AS id, CASE WHEN p_partkey <> o THEN 'project ' || o END AS kept_in FROM part JOIN f ON p_brand = k")
def cross_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).select(_k().alias("id"), "p_brand", F.concat(F.lit("project "), _k()).alias("project"))
    return audits.cross_listed(p, ["p_brand"], "id", "project").select("id", "kept_in")


@query("SELECT p_partkey AS id FROM part a WHERE p_size % 3 = 0 AND EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice = a.p_retailprice AND b.p_size % 3 <> 0)")
def retired_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.retired_copies(_part(spark, sf_dir), _z() % 3 == 0, ["p_retailprice"]).select(_k().alias("id"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Creation Homes' WHEN 1 THEN '' ELSE 'Kemps' END AS builder, CASE s_suppkey % 3 WHEN 1 THEN 'project' ELSE 'builder' END AS scope FROM supplier")
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 3 == 0, "Grove").when(k % 3 == 1, "Rise").otherwise("Kemps").alias("builder"), F.lit("builder").alias("scope"))
    return audits.relabelled(rows, spark.sql("SELECT * FROM VALUES ('Grove', 'Creation Homes', CAST(NULL AS STRING)), ('Rise', '', 'project') AS t(stored, builder, scope)"), "builder")


@query("SELECT 'The ' || upper(s_name) || ' Victoria' AS label, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def contained_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    two = F.concat("s_name", F.lit(" and "), F.regexp_replace("s_name", "#.*", "#000000001"))
    labels = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("The "), F.upper("s_name"), F.lit(" Victoria"))).when(F.col("s_suppkey") == 1, "GDEV").otherwise(two).alias("label"))
    return audits.contained_labels(labels, s.select(F.col("s_name").alias("name")))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Creation Homes' ELSE 'McMullan Bird' END AS name FROM customer WHERE c_custkey % 3 < 2")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, "FW: creation-homes list").when(k % 3 == 1, "McMullan  Bird - Stocklist.pdf (Creation)").otherwise("Recreation homes Abc")
    return audits.mentions(table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text")), spark.sql("SELECT * FROM VALUES ('Creation'), ('Creation Homes'), ('McMullan Bird'), ('Abc') AS t(name)"))


@query("SELECT * FROM (VALUES ('Avia Homes', 0, 1), ('Kemps', 1, NULL)) t(name, kind, u) CROSS JOIN (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 4 = 3) c".replace("SELECT * FROM", "SELECT name, kind, CASE WHEN kind = 0 THEN 1 ELSE -n END AS by FROM"))
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = table(spark, sf_dir, "supplier").select(F.when(k % 4 == 0, "AVIA Homes").when(k % 4 == 1, "Avia Home").when(k % 4 == 2, " ").otherwise("Kemps").alias("name"))
    return audits.display_names(names, spark.sql("SELECT * FROM VALUES ('Avia Homes', 1) AS t(name, ord)"))


@query("SELECT c_custkey AS id, 'B' AS builder, CASE c_custkey % 5 WHEN 0 THEN 'no section header' WHEN 1 THEN 'section header agrees' ELSE 'section header DISAGREES (A)' END AS note FROM customer WHERE c_custkey % 5 < 3")
def review_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = F.col("c_custkey"), lambda *x: F.array(*map(F.lit, x))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 5 < 3, a("aspen", "weak", "aspen")).when(k % 5 == 3, a("aspen", "birch")).otherwise(a("weak")).alias("tokens"), F.when(k % 5 == 1, "B").when(k % 5 > 1, "A").alias("header"))
    return audits.review_tier(rows, spark.sql("SELECT * FROM VALUES ('aspen', 'B', 10), ('birch', 'A', 30), ('weak', 'A', 9) AS t(token, builder, n)"))


@query("SELECT id, CASE WHEN id % 3 = 0 AND id > 0 THEN 1 WHEN id % 2 = 0 THEN 1 ELSE 0 END AS promo_selected, id % 3 = 0 AS changed FROM LISTINGS")
def promo_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir).select("id", F.col("id").cast("string").alias("content_hash"), (F.col("id") % 2 == 0).cast("int").alias("promo_selected"), F.lit(None).cast("string").alias("promo_selected_at"))
    return audits.select_marks(l, l.where("id % 3 = 0"), "content_hash", True, "2026-06-30 00:00:00").select("id", "promo_selected", "changed")


@query("SELECT s_nationkey AS portal, s_suppkey AS id, 'mapped' AS reading FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT s_nationkey, s_suppkey, 'adaptive' FROM supplier WHERE s_nationkey % 2 = 1")
def larger_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("portal"), F.col("s_suppkey").alias("id"))
    return audits.larger_result(s.where("portal % 2 = 0").withColumn("reading", F.lit("mapped")), s.withColumn("reading", F.lit("adaptive")), "portal")


@query("SELECT o_custkey AS listing_id, min_by(o_orderkey, o_orderkey) FILTER (o_orderkey % 3 > 0) AS page FROM orders GROUP BY 1 HAVING count_if(o_orderkey % 3 > 0) > 0")
def priced_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("listing_id"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"))
    return audits.priced_once(o, "listing_id")[0].select("listing_id", "page")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0")
def no_longer_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"))
    return audits.no_longer_extracted(s, s.where("id % 3 <> 0"), ["id", "name"]).select("id")
