"""Listing-shaped relations over the test tables. The SQL is portable, so that the same relation can feed a query and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A listing per part: keys as the survey maps them, gaps injected by remainders.
LISTINGS = """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'NSW' WHEN p_partkey % 4 = 1 THEN 'VIC' WHEN p_partkey % 4 = 2 THEN 'QLD' ELSE 'SA' END AS home,
  'NSW' AS state,
  CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_brand END AS suburb,
  CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_type END AS product_type,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 3 + 2 END AS bedrooms,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 2 + 1 END AS bathrooms,
  CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 3 END AS car_spaces,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_size * 20 + p_partkey % 13 AS DOUBLE) END AS land_sqm,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(100 + p_size * 3 AS DOUBLE) END AS house_sqm,
  p_retailprice * (10 + p_size % 20) / 10 AS price,
  CASE p_size % 5 WHEN 0 THEN 'Land' WHEN 1 THEN 'House & Land' WHEN 2 THEN 'Apartment' WHEN 3 THEN 'Commercial' ELSE '' END AS product,
  CASE p_partkey % 6 WHEN 0 THEN 'Available' WHEN 1 THEN 'SOLD' WHEN 2 THEN 'available ' WHEN 3 THEN NULL WHEN 4 THEN 'Under Offer' ELSE 'Mystery' END AS availability,
  CASE WHEN p_partkey % 8 = 0 THEN 'x' ELSE '' END AS superseded_by
FROM {part}
"""

#: A capture per lineitem, with a made-up line number as its id.
CAPTURES = """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS id,
  l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_returnflag FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def duck(sql: str, *tables: str) -> str:
    return sql.format(**{t: t for t in tables})


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, LISTINGS, "part")


LISTINGS_DUCK = duck(LISTINGS, "part")
