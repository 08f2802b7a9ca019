"""Queries on whole stocklist rows: facts, listings, labels, and the names and localities of banners. Rows are built from parts; the SQL states what each says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as r
from ..operators import rows as ops
from .catalogue import query as _query
from .lines import _k, _money, _part, _say

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)

_GAZETTEER = "SELECT * FROM VALUES ('Winter Valley', 'VIC'), ('Wyee', 'NSW'), ('Springfield', 'QLD'), ('Springfield', 'NSW'), ('Beaudesert', 'QLD') AS t(suburb, state)"


@query("""SELECT p_partkey AS id,
  CASE p_size % 6 WHEN 0 THEN 550000 + p_partkey WHEN 1 THEN 900000 + p_partkey WHEN 2 THEN 700000 + p_partkey WHEN 3 THEN 850000 + p_partkey WHEN 4 THEN 612000 END::DOUBLE AS price,
  CASE p_size % 6 WHEN 0 THEN 300000 + p_partkey WHEN 2 THEN 400000 + p_partkey END::DOUBLE AS land_price, CASE p_size % 6 WHEN 0 THEN 250000 WHEN 2 THEN 300000 END::DOUBLE AS build_price,
  CASE p_size % 6 WHEN 1 THEN 0.4 WHEN 3 THEN 0.6 ELSE 1.0 END::DOUBLE AS price_confidence,
  CASE p_size % 6 WHEN 0 THEN 4 WHEN 4 THEN p_partkey % 9 + 1 END::INT AS bedrooms, CASE p_size % 6 WHEN 0 THEN 2 WHEN 4 THEN 2 END::INT AS bathrooms, CASE p_size % 6 WHEN 0 THEN 2 WHEN 4 THEN 1 END::INT AS car_spaces,
  CASE p_size % 6 WHEN 0 THEN 400.5 WHEN 2 THEN 312 WHEN 4 THEN 450 END::DOUBLE AS land_size_sqm, CASE p_size % 6 WHEN 0 THEN 209 WHEN 2 THEN 165.5 END::DOUBLE AS house_size_sqm,
  CASE p_size % 6 WHEN 1 THEN 'Beaumoor Estate, Lot ' || p_partkey END AS lot_address, CASE p_size % 6 WHEN 0 THEN 'Aug 2026' WHEN 1 THEN 'Titled' WHEN 2 THEN 'tbc' WHEN 5 THEN 'Q1-26' END AS title_status,
  CASE p_size % 6 WHEN 1 THEN 'Mango Hill' WHEN 4 THEN 'Beaudesert' END AS suburb, CASE p_size % 6 WHEN 1 THEN 'QLD' END AS state FROM part""")
def row_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = lambda n: _money(_k() + n)
    text = _say(
        F.concat(F.lit("4 bed 2 bath 2 car LAND SIZE : 400.5 m2 HOUSE SIZE: 209 sqm $"), money(300000), F.lit(" $250,000 $"), money(550000), F.lit(" Land Registration: Aug 2026")),
        F.concat(F.lit("Beaumoor Estate, Lot "), _k(), F.lit("\nTitled now\n12 High Street Mango Hill, QLD 4509\n$200,000 $300,000 $"), money(900000)),
        F.concat(F.lit("312 m² with 165.5m2, tbc. Land price "), money(400000), F.lit(" House Price: 300000")),
        F.concat(F.lit("184.7m2 31.8m2 Total price : $ "), money(850000), F.lit(" rent $1,330 pw")),
        F.concat(F.lit("BEAUDESERT\n"), _k() % 9 + 1, F.lit("\n2\n1\n450 sq.m\nfrom $612,000")),
        "call us in Q1-26",
    )
    lines = _part(spark, sf_dir).select(_k().alias("id"), text.alias("line"))
    return ops.with_fields(lines, "line", spark.sql(_GAZETTEER), "id").drop("line")


@query("""SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 550000 + p_partkey ELSE 612000 END::DOUBLE AS price, CASE p_size % 5 WHEN 0 THEN 'Lot ' || p_partkey || ', Aberdeen' ELSE '105 Almond Street, Denman' END AS lot_address,
  CASE p_size % 5 WHEN 0 THEN 'Winter Valley' ELSE 'Wyee' END AS suburb, CASE p_size % 5 WHEN 0 THEN p_partkey::VARCHAR END AS lot_number, CASE p_size % 5 WHEN 0 THEN 'Aberdeen' ELSE 'Wyee / NSW' END AS estate_name,
  CASE p_size % 5 WHEN 0 THEN 0.98 ELSE 0.62 END::DOUBLE AS extraction_confidence, CASE p_size % 5 WHEN 0 THEN 2 ELSE 1 END::INT AS kinds FROM part WHERE p_size % 5 < 2""")
def row_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _say(
        F.concat(F.lit("Lot "), _k(), F.lit(" 4 bed 2 bath 350 m2 180 m2 $300,000 $250,000 $"), _money(_k() + 550000)), "105 Almond Street, Denman $612,000", "Land $714,900", "$1,300,000 $1,250,000 $1,250,000 $1,200,000 $1,100,000 of all", "nothing for sale",
    )
    context = _say("ʊ Aberdeen - Winter Valley - VIC", "Wyee / NSW", "x", "x", "x")
    link = lambda anchor, url: F.struct(F.lit(anchor).alias("anchor"), F.lit(url).alias("url"))
    links = _say(F.array(link("Brochure", "a"), link("more", "b"), link("flyer", "c")), F.array(link("site plan", "a")), F.array(link("", "")), F.array(link("", "")), F.array(link("", "")))
    rows = _part(spark, sf_dir).select(_k().alias("id"), text.alias("line"), context.alias("above"), links.alias("links"))
    return ops.to_listings(rows, spark.sql(_GAZETTEER), "id", "line", "above", "links").select("id", "price", "lot_address", "suburb", "lot_number", "estate_name", "extraction_confidence", F.size("links").alias("kinds"))


@query("""SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'Winter Valley' WHEN 1 THEN 'Wyee' WHEN 3 THEN 'Springfield' ELSE 'Wyee' END AS locality FROM part WHERE p_size % 6 <> 2 AND NOT (p_size % 6 = 4 AND p_partkey % 3 > 0) AND p_size % 6 <> 5""")
def banner_localities(spark: SparkSession, sf_dir: str) -> DataFrame:
    banner = _say("ʊ Aberdeen - Winter Valley - VIC - House & Land", "Harvest Hill | 1377 Hue Hue Road, Wyee", "One Part Contracts", "WYEE ESTATE - Wyee / SPRINGFIELD / NSW / SMSF", "Springfield Rise - wyee", "Springfield Gorge - Spec")
    state = F.when(_k() % 3 == 1, "VIC").when(_k() % 3 == 2, "QLD")
    rows = _part(spark, sf_dir).select(_k().alias("id"), banner.alias("banner"), F.when(F.col("p_size") % 6 == 4, state).alias("state"))
    return ops.banner_localities(rows, spark.sql(_GAZETTEER), "id", "banner", F.col("state"))


@query("""SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN (p_partkey % 500 + 1) || ' Almond Street, Denman' WHEN 1 THEN (p_partkey % 500 + 1) || ' Stony Drive, Alluvium' WHEN 2 THEN 'Lot ' || p_partkey || ', Hillcrest' WHEN 3 THEN 'Lot 103, Alluvium'
  WHEN 4 THEN 'Lot ' || p_partkey || ', Alluvium' WHEN 6 THEN '100 Park Royal Crescent, Alluvium' END AS label FROM part""")
def address_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = _k() % 500 + 1
    line = _say(
        F.concat(number, F.lit(" Almond Street, Denman $500,000")), F.concat(number, F.lit(" Stony Drive $650,000 STOCK LIST")), F.concat(F.lit("Lot "), _k(), F.lit(" , Hillcrest $ 700,000 -")), "103 Samara Estate Fraser Rise Available Bristol 15 $600,000",
        "Available 12 300 200 4 2 2 $600,000 package", "Package from $650,000 enquire now", "100 Park Royal Crescent, GALLERY STOCK LIST 2026", "1123 COMPLETED HOME 444 sold",
    )
    lot = F.when(F.col("p_size") % 8 == 4, _k().cast("string"))
    return _part(spark, sf_dir).select(_k().alias("id"), r.address_label(line, lot, F.lit("» Alluvium")).alias("label"))


@query("""SELECT p_brand || '/' || (p_size % 9) AS file, CASE min(p_size % 9) WHEN 0 THEN 'Creation Homes' WHEN 1 THEN 'G Developments' WHEN 2 THEN 'Kemps Living' ELSE '' END AS builder,
  CASE min(p_size % 9) WHEN 0 THEN 'Eastbury Wheelers Hill' WHEN 3 THEN 'Murcia' WHEN 4 THEN 'Coastal Range' ELSE '' END AS project FROM part GROUP BY 1""")
def file_builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    banner = _say("CREATION HOMES NSW STOCK LIST", "G-Developments 15-6-26", "kemps living (old) Pricelist2026", "Agent Stock List 167 Ingleburn Road, Leppington", "New Homes", "Homes", "Kemps Homes from $500,000", "Stage 1 building two", "ACCESS PROJECTS")
    label = _say("vic/eastbury-wheelers-hill-pricelist.pdf", "a/Pricelist2026.xlsx", "a/1101438-16S-PS-V1.pdf", "a/Murcia 15-6-26 A.xlsx", "b/c/Coastal_Range[1] (2) 2026.1.csv", "Eastbury", "a/Stage 1.pdf", "a/", "")
    rows = _part(spark, sf_dir).select(F.concat_ws("/", "p_brand", (F.col("p_size") % 9).cast("string")).alias("file"), banner.alias("banner"), label.alias("label"))
    return ops.builders_of_files(rows, "file", "banner", "label")
