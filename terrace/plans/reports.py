"""Queries on what goes out and what comes in: pairs compared in words, checklists per brief, mail by sender and by body line, exported grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare
from ..sources import files, mail
from .catalogue import query as _query
from .listings import table
from .shortlist import _SCORE_SQL, _scored

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)

_whole = lambda c: f"format('{{:,}}', round_even({c}, 0)::BIGINT)"
_one = lambda c: f"format('{{:.1f}}', ({c})::DOUBLE)"


def _ahead_sql(x: str, y: str) -> str:
    said = [f"CASE WHEN {x}.realistic < {y}.realistic AND {x}.realistic <> 0 THEN '$' || {_whole(f'{y}.realistic - {x}.realistic')} || ' lower once completion items are allowed for' END"]
    said += [f"CASE WHEN {x}.{f} > {y}.{f} AND {y}.{f} <> 0 THEN {_whole(f'{x}.{f} - {y}.{f}')} || ' m² more {w}' END" for f, w in (("house_sqm", "internal house area"), ("land_sqm", "land"))]
    said += [f"CASE WHEN {x}.{f} > {y}.{f} THEN ({x}.{f} - {y}.{f})::INT || ' more {w}' || CASE WHEN {x}.{f} - {y}.{f} > 1 THEN 's' ELSE '' END END" for f, w in (("bedrooms", "bedroom"), ("bathrooms", "bathroom"), ("car_spaces", "car space"))]
    said += [f"CASE WHEN {y}.extras > {x}.extras THEN 'hands over more complete — $' || {_whole(f'{y}.extras - {x}.extras')} || ' less to arrange separately' END"]
    said += [f"CASE WHEN {x}.total > {y}.total THEN 'scores ' || {_one(f'{x}.total')} || ' against ' || {_one(f'{y}.total')} || ' on the brief' END", f"CASE WHEN {x}.km < {y}.km THEN {_one(f'{y}.km - {x}.km')} || ' km closer to the target suburb' END"]
    return f"concat_ws('; ', {', '.join(said)})"


_confirm = lambda x: f"concat_ws('; ', CASE WHEN {x}.id % 3 = 0 THEN 'Soil report' END, CASE WHEN {x}.id % 3 = 0 THEN 'Title date' END, CASE WHEN {x}.verification <> 'Verified' THEN 'Listing status is ' || lower({x}.verification) END)"


@query(_SCORE_SQL + f""", q AS (SELECT * REPLACE (round(total, 6) AS total, CASE WHEN id % 4 < 3 THEN builder END AS builder) FROM r),
p AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, o_custkey FROM orders)
SELECT p.a, p.b, {_ahead_sql('x', 'y')} AS a_ahead, {_ahead_sql('y', 'x')} AS b_ahead, {_confirm('x')} AS confirm_a, {_confirm('y')} AS confirm_b,
  'On the figures the sources state, ' || concat_ws(', and ', CASE WHEN x.realistic <> y.realistic THEN coalesce(CASE WHEN x.realistic <= y.realistic THEN x.builder ELSE y.builder END, 'Option 1') || ' lands $' || {_whole('abs(x.realistic - y.realistic)')} || ' lower once completion items are allowed for' END,
    CASE WHEN x.total <> y.total THEN coalesce(CASE WHEN x.total > y.total THEN x.builder ELSE y.builder END, 'it') || ' scores higher against the brief (' || {_one('greatest(x.total, y.total)')} || ' / 100)' ELSE 'both score ' || {_one('x.total')} || ' / 100 against the brief' END)
    || '. This compares what is recorded for each package — the fit with ' || coalesce(CASE WHEN p.o_custkey % 3 > 0 THEN c_name END, 'the buyer') || '’s priorities is a judgement for your consultant.' AS verdict
FROM p JOIN q x ON p.a = x.id JOIN q y ON p.b = y.id LEFT JOIN customer ON c_custkey = p.o_custkey""")  # fmt: skip
def pair_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of a customer against their next one: where each is ahead, what to confirm, and the verdict."""
    k = F.col("id")
    rows = _scored(spark, sf_dir).withColumn("total", F.round("total", 6)).withColumn("builder", F.when(k % 4 < 3, F.col("builder"))).withColumn("advisories", F.when(k % 3 == 0, "Soil report; ; Title date").when(k % 3 == 1, ""))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    pairs = o.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b"), F.col("o_custkey").alias("c_custkey")).where("b IS NOT NULL")
    pairs = pairs.join(c, "c_custkey", "left").select("a", "b", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("client"))
    got = compare.compare(rows, pairs)
    return got.select("a", "b", *[F.array_join(x, "; ").alias(x) for x in ("a_ahead", "b_ahead", "confirm_a", "confirm_b")], "verdict")


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT o_custkey AS brief, o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'not stated' ELSE 'Lot ' || o_orderkey END AS address, CASE o_orderkey % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Unavailable' ELSE 'Verified' END AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT')
SELECT c_custkey AS brief, 1 AS item, 'QA Item 1 Failed: Client Brief incomplete or budget max missing.' AS failure FROM customer WHERE c_custkey % 7 = 0 OR c_acctbal <= 0
UNION ALL SELECT c_custkey, 2, 'QA Item 2 Failed: No candidate packages evaluated.' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM n)
UNION ALL SELECT brief, 5, 'QA Item 5 Failed: Property ' || address || ' is Pending Confirmation without explicit consultant waiver.' FROM s WHERE status = 'Pending' AND k % 8 <> 0
UNION ALL SELECT brief, 5, 'QA Item 5 Failed: Unavailable property ' || address || ' included in shortlist.' FROM s WHERE status = 'Unavailable'
UNION ALL SELECT brief, 6, 'QA Item 6 Failed: Price breakdown missing for ' || address || '.' FROM s WHERE k % 11 = 0
UNION ALL SELECT brief, 11, 'QA Item 11 Failed: 100-point scoring matrix not calculated for ' || address || '.' FROM s WHERE k % 13 = 0""")
def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each customer's urgent orders from going out."""
    k, o, b = F.col("o_orderkey"), table(spark, sf_dir, "orders"), F.col("c_custkey")
    briefs = table(spark, sf_dir, "customer").select(b.alias("brief"), F.when(b % 7 != 0, F.col("c_name")).alias("client"), F.col("c_acctbal").alias("budget_max"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("brief"), F.when(k % 9 != 0, F.concat(F.lit("Lot "), k.cast("string"))).alias("address"), F.when(k % 4 == 0, "Pending").when(k % 4 == 1, "Unavailable").otherwise("Verified").alias("verification"),
        F.when(k % 8 == 0, True).alias("approved"), F.when(k % 11 != 0, F.col("o_totalprice")).alias("realistic"), F.when(k % 13 != 0, 70.0).alias("total"),
    )
    return compare.checklist(briefs, o.select(F.col("o_custkey").alias("brief")), urgent)


@query("""SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'Acme Homes' WHEN 1 THEN 'Bolton' WHEN 2 THEN 'Creation Homes' WHEN 3 THEN 'Hattan Homes' WHEN 6 THEN 'newco.example' WHEN 7 THEN (SELECT min(s_name) FROM supplier) END AS builder,
  CASE c_custkey % 8 WHEN 0 THEN 'domain' WHEN 1 THEN 'label' WHEN 2 THEN 'mention' WHEN 3 THEN 'sender' WHEN 6 THEN 'sender' WHEN 7 THEN 'mention' END AS rule FROM customer WHERE c_custkey % 8 <> 5""")
def mail_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who each message is from, and which rule said so."""
    k, names = F.col("c_custkey") % 8, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    pick = lambda *shapes: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in shapes]), (k + 1).cast("int"))
    sender = pick("Sales <a@acme-homes.example>", "x@bolton.test", "x@gmail.com", "Me <me@HATTAN.com.au>", "me@ours.example", "x@other.example", "x@www.newco.example", "x@mail.yahoo.com")
    first = names.agg(F.min("name")).first()[0]
    m = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), sender.alias("from"), pick("hello", "Updated Stocklist", "FW: lots", "Stock list", "Stocklist", "hello", "availability", f"stocklist of {first}").alias("subject"),
        F.when(k > 0, F.array(pick("", "list.xlsx", "Creation Homes - price list.pdf", "a.csv", "a.csv", "me.jpg", "b.pdf", "c.xls"))).alias("attachments"),
    )
    domains = spark.sql("SELECT * FROM VALUES ('acme-homes.example', 'Acme Homes', 1), ('sales.bolton.example', 'Bolton', 2) AS t(domain, builder, ord)")
    known = names.unionByName(spark.sql("SELECT * FROM VALUES ('Creation'), ('Creation Homes'), ('Hattan Homes') AS t(name)"))
    return mail.senders(m, domains, known, own=("ours.example",)).select("id", "builder", "rule")


@query("""SELECT c_custkey AS id, 1 AS line_no, (500 + c_custkey % 400) * 1000.0 AS price, 'Lot ' || (c_custkey % 50 + 1) || ' Maple Street $' || (500 + c_custkey % 400) || ',000 4 bed' AS lot_address FROM customer WHERE c_custkey % 40 >= 10 AND c_custkey % 5 > 0
UNION ALL SELECT c_custkey, 4, 1050000.0, 'from $1,050,000 on request' FROM customer WHERE c_custkey % 40 >= 10 AND c_custkey % 5 > 0""")
def mail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced lines of recent bodies whose attachments gave no rows; a line that is too long, too dear or without a price is none."""
    k = F.col("c_custkey")
    lot = F.concat(F.lit("Lot "), (k % 50 + 1).cast("string"), F.lit(" Maple Street $"), (500 + k % 400).cast("string"), F.lit(",000 4 bed"))
    body = F.concat_ws("\r\n", F.lit("Hi all, see below"), lot, F.concat(F.lit("Lot 9 $400,000 "), F.repeat(F.lit("and more "), 60)), F.lit("Lot 3 $2,100,000"), F.lit(" from  $1,050,000 on request "), F.lit(""))
    m = table(spark, sf_dir, "customer").select(k.alias("id"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 40).cast("int")).alias("sent"), body.alias("body"))
    return mail.body_listings(m, F.lit("2026-01-11").cast("date"), 1_000_000.0, m.where("id % 5 = 0")).select("id", "line_no", "price", "lot_address")


@query("""SELECT c_custkey AS id, 0 AS row_no, 'Lot|Rent|Size' AS cells FROM customer UNION ALL SELECT c_custkey, 1, 'A1|$' || (1 + c_custkey % 9) || ',500|350.5' FROM customer
UNION ALL SELECT c_custkey, 2, '|450|' || CASE WHEN c_custkey % 2 = 0 THEN '$2,000' ELSE '2000' END FROM customer""")
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wire grid as its sheet: columns by their order, rows as they appear, money by format or title, the later of two cells on one place."""
    k = F.col("c_custkey")
    rent, flag = ((1 + k % 9) * 1000 + 500).cast("string"), F.when(k % 2 == 0, F.lit(str(4645 << 12))).otherwise("0")
    body = F.concat(F.lit("C:7=Size@3;C:5=Lot@1;C:6=Rent@2;D:x/5/old//0;D:x/5/A1//0;D:x/7//350.50/0;D:x/6//"), rent, F.lit("/0;D:b/7//2000/"), flag, F.lit(";D:b/6//450.0/0;D:b/9/lost//0;"))
    bodies = table(spark, sf_dir, "customer").select(k.alias("id"), body.alias("body"))
    got = files.grid_rows(bodies, r"C:(\d+)=(\w+)@(\d+);", r"D:(\w+)/(\d+)/(\w*)/([\d.]*)/(\d+);")
    return got.select("id", "row_no", F.array_join("cells", "|").alias("cells"))
