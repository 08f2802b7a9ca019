"""Queries on file sources and sinks: a table is written in the source's format to the shared folder and read by its reader; the SQL states what that must give."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places
from ..session import shared_folder
from ..sources import files, tables
from .catalogue import query as _query
from .listings import table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)
#: Ids of a file at most, so that files grow in number and not in size.
FILE_IDS = 500


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


def _as_csv(df: DataFrame) -> str:
    path = _folder(df.sparkSession)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def _as_texts(lines: DataFrame, first: str, last: Column) -> str:
    """Text files of lines (file, ord, value), each with a first and last line of its own."""
    path = _folder(lines.sparkSession)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "\n")  # a file's lines, as its reader has them
    lines.groupBy("file").agg(F.concat_ws("\n", F.lit(first), body, last).alias("value")).write.partitionBy("file").text(path)
    return path


@query("""SELECT c_mktsegment AS suburb, 'NSW' AS state, CASE WHEN c_custkey % 3 = 0 THEN 3 END::INT AS bedrooms, (c_custkey * 1000)::DOUBLE AS price, CASE WHEN c_custkey % 2 = 0 THEN 1200.5 END::DOUBLE AS rent_weekly, NULL::DOUBLE AS land_sqm,
  CASE WHEN c_custkey % 4 = 0 THEN 'the "' || c_name || '", list' END AS source, NULL AS date_checked FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0""")
def comparables_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparables as spreadsheets export them: signs, separators, quotes inside quotes, a column that isn't there."""
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise("  ").alias("Suburb"), F.lit("nsw").alias("STATE"), F.when(k % 3 == 0, "3").when(k % 3 == 1, "lots").alias("bedrooms"), F.when(k % 7 == 0, "0").otherwise(F.concat(F.lit("$"), F.format_number(k * 1000, 0))).alias("Price"),
        F.when(k % 2 == 0, " 1,200.50 ").alias("rent_weekly"), F.when(k % 4 == 0, F.concat(F.lit('the "'), "c_name", F.lit('", list'))).alias("source"),
    )
    return files.comparables(spark, _as_csv(raw))


@query("""SELECT c_name AS lot_address, c_mktsegment AS suburb, 'VIC' AS state, NULL AS builder_name, (c_custkey % 5)::INT AS bedrooms, NULL::DOUBLE AS bathrooms, NULL::INT AS car_spaces, 450.5::DOUBLE AS land_sqm, NULL::DOUBLE AS house_sqm, NULL::DOUBLE AS land_price, NULL::DOUBLE AS build_price,
  CASE WHEN c_custkey % 3 > 0 THEN 500000 + c_custkey END::DOUBLE AS price FROM customer WHERE c_custkey % 6 > 0""")
def dropped_stocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped stocklist by its header's aliases; what it doesn't state stays null."""
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select(
        F.when(k % 6 > 0, F.col("c_name")).alias("Lot"), F.col("c_mktsegment").alias("Suburb"), F.lit(" vic").alias("State"), (k % 5).alias("BEDS"), F.lit("450.5").alias("LandSqm"), F.when(k % 3 > 0, F.concat(F.lit("$ "), F.format_number(500000 + k, 0))).otherwise("POA").alias("TotalPrice"),
    )
    return files.drop_csv(spark, _as_csv(raw))


_REGISTRY_SQL = """SELECT s_name AS builder_name, CASE s_suppkey % 3 WHEN 0 THEN 'NSW,QLD' WHEN 1 THEN 'VIC' ELSE '' END AS states, s_suppkey % 2 = 0 AS is_on_e_agent, CASE WHEN s_suppkey % 2 = 0 THEN 'e_agent' WHEN s_suppkey % 5 = 0 THEN 'portal' WHEN s_suppkey % 7 = 0 THEN 'email_pdf' ELSE 'direct_contact' END AS stock_channel,
  'say "' || s_suppkey || '", by ' || CASE WHEN s_suppkey % 7 = 0 THEN 'EMAIL' ELSE 'phone' END AS notes, s_suppkey FROM supplier WHERE s_suppkey % 11 > 0"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as registries by position; what follows the marker row is another list."""
    k = F.col("s_suppkey")
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    states = F.when(k % 3 == 0, "nsw/ QLD").when(k % 3 == 1, "vic").otherwise("")
    note = F.concat(F.lit('say "'), k.cast("string"), F.lit('", by '), F.when(k % 7 == 0, "EMAIL").otherwise("phone"))
    cells = [F.lit("x"), F.lit("login"), F.lit("y"), F.when(k % 11 > 0, F.col("s_name")).otherwise(""), quoted(states), F.lit("yes"), F.when(k % 2 == 0, "Yes, listed").otherwise("no"), F.when(k % 5 == 0, "https://p.example").otherwise(""), F.lit(""), F.lit("0400 000 000"), quoted(note)]
    cells[6] = quoted(cells[6])
    lines = table(spark, sf_dir, "supplier").select(F.floor(k / FILE_IDS).alias("file"), k.alias("ord"), F.concat_ws(",", *cells).alias("value"))
    return files.registry(spark, _as_texts(lines, "NAME,,,BUILDER", F.lit("a,b,c,LinkedIn Link\nx,x,x,Someone else,vic")))


@query(f"SELECT * EXCLUDE (s_suppkey) FROM ({_REGISTRY_SQL})")
def registry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select("builder_name", F.array_join("states", ",").alias("states"), "is_on_e_agent", "stock_channel", "notes")


@query(f"""WITH r AS (SELECT builder_name, s_suppkey FROM ({_REGISTRY_SQL})), f AS (SELECT DISTINCT right(s_name, 4) AS name FROM supplier)
SELECT name, min(builder_name) AS builder_name FROM f LEFT JOIN r ON contains(lower(builder_name), lower(name)) GROUP BY 1 UNION ALL SELECT '', NULL""")
def registry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's row that a part of a name finds; the order is that of names here, since files have none among them."""
    reg = _registry(spark, sf_dir).withColumn("ord", F.col("builder_name"))
    asked = table(spark, sf_dir, "supplier").select(F.right("s_name", F.lit(4)).alias("name")).distinct()
    return files.find_builder(reg, asked.union(spark.range(1).select(F.lit(""))))


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS name, NULL AS nowhere FROM part")
def positional_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional JSON and lists of objects: named columns, those that no file has as null."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.floor(k / FILE_IDS).alias("file"), k.alias("id"), F.when(k % 3 > 0, F.col("p_name")).alias("name"))
    text = F.concat(F.lit("["), F.col("id").cast("string"), F.lit(","), F.coalesce(F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", ""), F.lit("null")), F.lit("]"))
    keyed = p.where("file % 2 = 0").groupBy("file").agg(F.concat(F.lit('{"keys":["id","name"],"rows":['), F.array_join(F.collect_list(text), ","), F.lit("]}")).alias("value"))
    objects = p.where("file % 2 = 1").groupBy("file").agg(F.to_json(F.collect_list(F.struct("id", "name"))).alias("value"))
    path = _folder(spark)
    keyed.unionByName(objects).write.partitionBy("file").text(path)
    return files.positional_json(spark, path, ["id", "name", "nowhere"]).drop("ord")


@query("""WITH g AS (SELECT lower(p_brand || ' ' || (p_partkey % 50)) AS key, p_brand || ' ' || (p_partkey % 50) AS suburb, CASE p_size % 3 WHEN 0 THEN 'NSW' WHEN 1 THEN 'QLD' ELSE 'VIC' END AS state FROM part WHERE p_partkey % 9 > 0)
SELECT key, min(suburb) AS name, string_agg(DISTINCT state, ',' ORDER BY state) AS states, CASE WHEN count(DISTINCT state) = 1 THEN min(state) END AS only, count(DISTINCT state) AS points FROM g GROUP BY 1""")
def gazetteer_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gazetteer's file and what its four lookups say of each name; rows without a point aren't in it."""
    k, s = F.col("p_partkey"), F.col("p_size")
    raw = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.concat_ws(" ", "p_brand", (k % 50).cast("string"))).alias("suburb"), F.when(s % 3 == 0, "nsw").when(s % 3 == 1, "QLD").otherwise("vic ").alias("state"), F.when(k % 9 > 0, F.lit("-33.5")).otherwise("?").alias("lat"), (150 + s / 100).alias("lng"))
    said = places.lookups(files.gazetteer(spark, _as_csv(raw)))
    per = said["points"].groupBy("key").agg(F.count("*").alias("points"))
    return said["names"].join(said["states"], "key").join(per, "key").select("key", "name", F.array_join("states", ",").alias("states"), "only", "points")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, 'https://x.example/' || o_orderkey AS plan_url FROM orders")
def published_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is published, read back: the public columns, after every guard."""
    path, key = _folder(spark), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("plan_url", F.concat(F.lit("https://x.example/"), key.cast("string")))
    tables.publish(rows, {"o_orderkey", "o_orderstatus", "o_totalprice", "plan_url"}, path, None)
    return tables.scan(spark, path)
