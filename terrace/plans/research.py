"""Queries on research runs: briefs, benchmarks with a stored resort, payloads, run records, links beside rows, stored rows judged again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import research as ops
from ..operators import rows as row_ops
from .catalogue import query as _query
from .lines import _k, _money, _part
from .listings import listings, table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 9 = 8 THEN 'Unnamed Client' ELSE c_name END AS client_name, CASE WHEN c_custkey % 9 = 8 THEN 'QLD' WHEN c_custkey % 4 = 0 THEN 'VIC' ELSE 'QLD' END AS state,
  CASE WHEN c_custkey % 9 = 8 THEN 'Owner Occupier' WHEN c_mktsegment = 'BUILDING' THEN 'Investor' WHEN c_mktsegment = 'MACHINERY' THEN 'First Home Buyer' WHEN c_mktsegment = 'FURNITURE' THEN 'SMSF' ELSE 'Owner Occupier' END AS buyer_type,
  CASE c_custkey % 9 WHEN 0 THEN 700000 + c_custkey WHEN 1 THEN 850000 WHEN 5 THEN 12.5 ELSE 0 END::DOUBLE AS budget_max,
  CASE WHEN c_custkey % 9 <> 8 AND c_custkey % 2 = 0 THEN 500000 ELSE CASE c_custkey % 9 WHEN 0 THEN 700000 + c_custkey WHEN 1 THEN 850000 WHEN 5 THEN 12.5 ELSE 0 END END::DOUBLE AS preferred_spending_cap,
  CASE WHEN c_custkey % 9 = 8 THEN 0 WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END::BIGINT AS bedrooms_min, CASE WHEN c_custkey % 9 <> 8 AND c_custkey % 7 = 0 THEN 2 END::BIGINT AS storeys_max,
  CASE WHEN c_custkey % 9 = 8 THEN '' ELSE CASE c_custkey % 6 WHEN 0 THEN 'Austral|Denman' WHEN 1 THEN 'Austral|5|2.5' WHEN 2 THEN '5' ELSE '' END END AS suburbs FROM customer""")
def research_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs as forms and callers send them: numbers as text, nulls, overflows, flags, lists or bare values, and things that are no brief."""
    k = F.col("c_custkey")
    budget = F.element_at(F.array(*[F.lit(x) for x in ("@", "850000", '"NaN"', "1e400", "true", '" 12.5 "', "null", '"lots"')]), (k % 9 + 1).cast("int"))
    budget = F.when(k % 9 == 0, F.concat(F.lit('"$'), F.format_number(700000 + k, 0), F.lit('"'))).otherwise(budget)
    buyer = F.create_map(*[F.lit(x) for x in ("BUILDING", "An INVESTOR", "MACHINERY", "my first smsf", "FURNITURE", "SMSF fund")])[F.col("c_mktsegment")]
    places = F.when(k % 6 == 0, '"Austral, ,Denman "').when(k % 6 == 1, '[" Austral", 5, {"a": 1}, null, [1], 2.5, ""]').when(k % 6 == 2, "5").when(k % 6 == 3, '{"a": 1}').when(k % 6 == 4, "null").otherwise("true")
    parts = {
        "client_name": F.when(k % 5 == 0, "null").otherwise(F.to_json(F.array("c_name")).substr(F.lit(2), F.length("c_name") + 2)), "state": F.when(k % 4 == 0, '"vic"').otherwise('""'), "buyer_type": F.concat(F.lit('"'), F.coalesce(buyer, F.lit("")), F.lit('"')),
        "budget_max": budget, "preferred_spending_cap": F.when(k % 2 == 0, '"500,000"').otherwise("null"), "bedrooms_min": F.when(k % 3 == 0, '"3"').when(k % 3 == 1, "2.9").otherwise("false"), "storeys_max": F.when(k % 7 == 0, "2").otherwise("null"), "primary_suburbs": places,
    }
    text = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()]), F.lit("}"))
    text = F.when(k % 9 != 8, text).when(k % 2 == 0, "[1, 2]").when(k % 3 == 0, "not a brief")
    out = ops.parse_briefs(table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("brief")), "brief")
    return out.select("id", "client_name", "state", "buyer_type", "budget_max", "preferred_spending_cap", "bedrooms_min", "storeys_max", F.array_join("primary_suburbs", "|").alias("suburbs"))


@query("""WITH m AS (SELECT suburb, avg(bedrooms * 100.0) AS median FROM LISTINGS GROUP BY 1), v AS (SELECT l.id, m.median, round((l.land_sqm - m.median) / m.median * 100, 6) AS variance FROM LISTINGS l LEFT JOIN m ON l.suburb = m.suburb)
SELECT id, CASE WHEN id % 4 = 0 THEN 'market' WHEN median IS NOT NULL THEN 'internal' ELSE 'none' END AS basis,
  CASE WHEN id % 4 = 0 THEN 15.0 WHEN median IS NULL OR variance IS NULL THEN 7.5 WHEN variance < -5 THEN 12.5 WHEN variance <= 5 THEN 11 WHEN variance <= 12 THEN 9 ELSE 5 END::DOUBLE AS points,
  CASE WHEN id % 4 = 0 THEN 'Below market' WHEN median IS NOT NULL THEN CASE WHEN id % 3 = 0 THEN 'Good' ELSE 'Compared with comparable stock' END END AS label, id % 4 <> 0 AS manual FROM v""")
def benchmark_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's benchmark where there is one, else the suburb's own, which never claims to be the market's."""
    l, i = listings(spark, sf_dir), F.col("id")
    own = l.where("suburb IS NOT NULL").groupBy("suburb").agg(F.avg(F.col("bedrooms") * 100.0).alias("median"))
    variance = F.round((F.col("land_sqm") - F.col("median")) / F.col("median") * 100, 6)
    market = F.when(i % 4 == 0, F.struct(F.lit(15.0).alias("points"), F.lit(1.0).alias("median"), F.lit(-9.0).alias("variance"), F.lit("Below market").alias("label")))
    b = ops.benchmark_or_stored(market, F.col("median"), variance, F.when(i % 3 == 0, "Good").otherwise(""), F.lit(None).cast("string"))
    return l.join(own, "suburb", "left").select("id", b.alias("b")).select("id", "b.basis", "b.points", "b.label", "b.manual")


_RUN_SQL = """WITH b AS (SELECT c_custkey AS record_id, c_name AS client_name, 900000.0 + c_custkey AS budget_max, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS suburb FROM customer),
c AS (SELECT o_custkey AS record_id, o_orderkey AS id, 'Lot ' || (o_orderkey % 500) AS lot_address, o_orderpriority AS suburb, floor(o_totalprice)::BIGINT AS price, (o_orderkey % 61 + 35)::DOUBLE + 0.5 * (o_orderkey % 2) AS score, o_orderstatus = 'O' AS kept FROM orders),
n AS (SELECT record_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS rejected FROM c GROUP BY 1)
"""


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Briefs of customers, and their orders as candidates: open ones pass, the others are rejected."""
    k = F.col("c_custkey")
    suburbs = F.when(k % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    b = table(spark, sf_dir, "customer").select(k.alias("record_id"), F.col("c_name").alias("client_name"), F.lit("QLD").alias("state"), (900000.0 + k).cast("double").alias("budget_max"), suburbs.alias("primary_suburbs"))
    key = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("record_id"), key.alias("id"), F.concat(F.lit("Lot "), (key % 500).cast("string")).alias("lot_address"), F.col("o_orderpriority").alias("suburb"), F.floor("o_totalprice").alias("price"),
        ((key % 61 + 35).cast("double") + 0.5 * (key % 2)).alias("score"), F.when(key % 3 == 0, "Hold").otherwise("Recommend").alias("recommendation"), (F.col("o_orderstatus") == "O").alias("kept"),
    )
    return b, c.where("kept"), c.where("NOT kept")


@query(_RUN_SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, id) AS rank FROM c WHERE kept),
s AS (SELECT record_id, string_agg(rank || '. ' || lot_address || ', ' || suburb || ' - $' || format('{:,}', price) || ' (Score: ' || score || '/100 - ' || CASE WHEN id % 3 = 0 THEN 'Hold' ELSE 'Recommend' END || ')', chr(10) ORDER BY rank) AS lines,
  count(*) AS n, min(lot_address) FILTER (rank = 1) AS top, min(price) FILTER (rank = 1) AS price, min(score) FILTER (rank = 1) AS score FROM t WHERE rank <= 5 GROUP BY 1)
SELECT b.record_id, coalesce(top, 'No qualifying properties found') AS top_match, coalesce(s.price, 0)::DOUBLE AS top_price, coalesce(s.score, 0)::DOUBLE AS top_score, coalesce(s.n, 0) + coalesce(n.rejected, 0) AS reviewed,
  md5('Property research completed' || chr(10) || 'Record: ' || b.record_id || chr(10) || 'Client: ' || client_name || ' | Budget ceiling: $' || format('{:,}', budget_max::BIGINT) || chr(10) || chr(10) || 'Shortlist:' || chr(10) || coalesce(lines, 'None') || chr(10) || chr(10) || 'Rejected: ' || coalesce(n.rejected, 0) || ' filtered out.' || chr(10) || 'Status: Awaiting Consultant Review') AS note_md5,
  'Review Property Research for ' || client_name AS title FROM b LEFT JOIN s USING (record_id) LEFT JOIN n USING (record_id)""")
def research_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of every record, read back from its JSON."""
    v = F.parse_json("payload")
    get = lambda path, t: F.variant_get(v, f"$.{path}", t)
    fields = "custom_fields_update"
    return ops.payloads(*_run(spark, sf_dir), 5, "2026-01-01 00:00:00").select(
        "record_id", get(f"{fields}.top_property_match", "string").alias("top_match"), get(f"{fields}.top_property_price", "double").alias("top_price"), get(f"{fields}.top_property_score", "double").alias("top_score"),
        get(f"{fields}.candidates_reviewed", "long").alias("reviewed"), F.md5(get("internal_note", "string").cast("binary")).alias("note_md5"), get("consultant_review_task.title", "string").alias("title"),
    )


@query(_RUN_SQL + "SELECT b.record_id, client_name, 'QLD' AS state, suburb, budget_max, coalesce(kept, 0) AS shortlist_count, coalesce(rejected, 0) AS rejected_count FROM b LEFT JOIN n USING (record_id)")
def research_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_records(*_run(spark, sf_dir))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS line, l_linenumber * 12.0 AS top, l_linenumber * 12.0 + CASE WHEN l_linenumber % 3 = 0 THEN 22 ELSE 8 END AS bottom FROM lineitem),
u AS (SELECT l_orderkey AS page, l_linenumber * 11.0 + l_partkey % 20 AS y, l_suppkey % 50 AS x, 'u' || l_partkey AS uri FROM lineitem WHERE l_partkey % 7 > 0)
SELECT r.page, r.line, coalesce(string_agg(uri, ' ' ORDER BY x, uri), '') AS links FROM r LEFT JOIN u ON r.page = u.page AND r.line % 5 > 0 AND u.y BETWEEN top - 2 AND bottom + 2 GROUP BY 1, 2""")
def row_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links beside each row of a page."""
    l, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    top = n * 12.0
    r = l.select(F.col("l_orderkey").alias("page"), n.alias("line"), F.when(n % 5 > 0, top.cast("string")).otherwise("?").alias("top"), (top + F.when(n % 3 == 0, 22).otherwise(8)).alias("bottom")).distinct()
    u = l.where("l_partkey % 7 > 0").select(F.col("l_orderkey").alias("page"), (n * 11.0 + F.col("l_partkey") % 20).alias("y"), (F.col("l_suppkey") % 50).alias("x"), F.concat(F.lit("u"), "l_partkey").alias("uri"))
    return ops.links_in_band(r, u, ["page"], "line").select("page", "line", F.array_join("links", " ").alias("links"))


@query("SELECT p_partkey AS id, CASE p_size % 8 WHEN 1 THEN 'a column header' WHEN 2 THEN 'no longer a listing' WHEN 3 THEN 'no longer a listing' WHEN 4 THEN 'no longer a listing' ELSE '' END AS reason FROM part")
def rows_judged_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lines under the tests that new rows pass: a lot, a street or rooms save a wall of prices."""
    wall = "$1,300,000 $1,250,000 $1,250,000 $1,200,000 $1,100,000"
    text = F.when(F.col("p_size") % 8 < 7, F.element_at(F.array(
        F.concat(F.lit("Lot "), _k(), F.lit(" 4 bed 2 bath 350 m2 $300,000 $250,000 $"), _money(_k() + 550000)), *[F.lit(x) for x in ("Lot Street Suburb Price Status", f"{wall} of all", "Land $714,900", "nothing for sale", f"Lot 5 {wall}", f"12 Almond Street {wall}")],
    ), (F.col("p_size") % 8 + 1).cast("int"))).otherwise("")
    return row_ops.judged_again(_part(spark, sf_dir).select(_k().alias("id"), text.alias("line")), "line").select("id", "reason")
