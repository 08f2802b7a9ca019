"""Queries on source lines, links, pages and conversations. Lines are built from parts; the SQL states what each line says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links, text
from ..functions.values import is_fresh, text_key, variant_key
from ..operators import lines as ops
from ..operators import places
from .catalogue import query as _query
from .listings import listings, table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


def _k() -> Column:
    return F.col("p_partkey")


def _z() -> Column:
    return F.col("p_size")


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _say(*shapes: str | Column, by: Column | None = None) -> Column:
    by = _z() if by is None else by
    return F.element_at(F.array(*[F.lit(s) if isinstance(s, str) else s for s in shapes]), (by % len(shapes) + 1).cast("int"))


def _money(c: Column) -> Column:
    return F.format_number(c, 0)


@query("SELECT p_partkey AS id, 'Lot 5 $' || (900 + p_partkey % 99) || ',' || lpad((p_size * 10)::VARCHAR, 3, '0') || ' and $1,455,900 or $10 20 m' AS line FROM part")
def money_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (900 + _k() % 99).cast("string")
    split = F.concat(F.lit("Lot 5 $ "), F.substring(n, 1, 1), F.lit(" "), F.substring(n, 2, 2), F.lit(","), F.lpad((_z() * 10).cast("string"), 3, "0"), F.lit("  and $ 1 ,455,900 or $10 20 m"))
    return _part(spark, sf_dir).select(_k().alias("id"), text.clean(split).alias("line"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN [300000.0 + p_partkey, 250000, 550000 + p_partkey] WHEN 1 THEN [612000.0] WHEN 2 THEN [400000.0, 500000] ELSE [] END::DOUBLE[]::VARCHAR AS prices FROM part")
def ordered_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = _money(300000 + _k()), _money(550000 + _k())
    line = _say(F.concat(F.lit("Land $"), a, F.lit(" build $250,000 total $"), c), "Package $612,000 then $61,200 5.2% yield and $1,200 pw", "$400,000 land, $100,000 build and pw $500,000 all", "call us, $45,000 deposit, rent $52,000 pa")
    return _part(spark, sf_dir).select(_k().alias("id"), F.concat(F.lit("["), F.array_join(F.transform(text.ordered_prices(line), lambda v: F.format_string("%.1f", v)), ", "), F.lit("]")).alias("prices"))


@query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 3 END::INT AS bedrooms, CASE p_size % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2.5 WHEN 3 THEN 2 END::DOUBLE AS bathrooms, CASE p_size % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 END::INT AS car_spaces FROM part")
def bbc_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("4 beds / 2 baths / 2 cars, 312 m2, $612,000", "12/08/2026 3x2x1 Lot 14", "5 | 2.5 | 2 Q2 2027", "3B2B from 5.5%", "4 beds or 3 bed", "Total 149 149 55 10 20")
    return _part(spark, sf_dir).select(_k().alias("id"), text.specs(line).alias("s")).select("id", "s.*")


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN '3064' WHEN 1 THEN '4207' WHEN 4 THEN '2765' END AS postcode FROM part")
def postcode_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("Lot 2427 Example St, Craigieburn 3064", "CC-0122 Stage 2026 Yarrabilba 4207 titled Sep 2026", "Fraser Rise 1106 3000 m2", "3064 leads the line", "Marsden Park 2765, settled 2026-08-01, 2030")
    return _part(spark, sf_dir).select(_k().alias("id"), text.postcode(line).alias("postcode"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 15000 WHEN 1 THEN 7500 WHEN 2 THEN 20000 END::DOUBLE AS incentive FROM part")
def incentive(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("Rebate of $15,000 on this home", "$7,500 cash back and a $5,000 gift", "bonus $20k today", "weekly rent $650 and yield 5%", "$400,000 discount package")
    return _part(spark, sf_dir).select(_k().alias("id"), text.incentive(line).alias("incentive"))


@query("SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'Available' WHEN 1 THEN 'Under Offer' WHEN 2 THEN 'On Hold' WHEN 3 THEN 'Not Available' WHEN 4 THEN 'Sold' WHEN 5 THEN 'Reserved' END AS status FROM part")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("lot 3 AVAILABLE now", "Under  Offer, was available", "hold until May", "currently unavailable", "SOLD (was on sale)", "Deposit taken", "nothing said")
    return _part(spark, sf_dir).select(_k().alias("id"), text.availability(line).alias("status"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'SINGLE' WHEN 1 THEN 'DOUBLE' WHEN 2 THEN 'DOUBLE' WHEN 4 THEN 'SINGLE' END AS storey FROM part")
def storey(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("a single-storey home", "2 level townhouse", "Lot 7 facing the park DOUBLE north", "SINGLE contract package", "SINGLE Contract of the usual kind for all of the lots here, and far on it says SINGLE by the lake to the north of all")
    return _part(spark, sf_dir).select(_k().alias("id"), text.storey(line).alias("storey"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_partkey::VARCHAR || 'A' WHEN 1 THEN 'CC-0122' END AS lot, CASE p_size % 3 WHEN 0 THEN 12.5 WHEN 1 THEN 10.0 END::DOUBLE AS frontage, CASE WHEN p_size % 3 = 1 THEN 'Kemps Creek' END AS estate, CASE WHEN p_size % 3 = 2 THEN 97.0 END::DOUBLE AS area FROM part")
def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say(F.concat(F.lit("lot "), _k().cast("string"), F.lit("A frontage (m): 12.5")), "CC-0122 lot 9 Kemps Creek Estate 10 m wide", "Apartment 501, 97 m² internal")
    return _part(spark, sf_dir).select(_k().alias("id"), text.lot_number(line).alias("lot"), text.frontage(line).alias("frontage"), text.estate(line).alias("estate"), text.apartment_area(line).alias("area"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 725000 WHEN 1 THEN 1250000 WHEN 2 THEN 725000 END::DOUBLE AS short, CASE p_size % 4 WHEN 2 THEN 725000 END::DOUBLE AS first, CASE p_size % 4 WHEN 2 THEN 725000 END::DOUBLE AS labelled FROM part")
def price_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("From $725k", "1.25m", "725000 is the package price: $725,000", "Total 149 149")
    return _part(spark, sf_dir).select(_k().alias("id"), text.price_short(line).alias("short"), text.price_first(line).alias("first"), text.labelled_price(line, r"(?:package|total)\s*(?:price)?").alias("labelled"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN '2765' END AS postcode, CASE p_size % 3 WHEN 0 THEN 'NSW' WHEN 1 THEN 'VIC' END AS state, CASE p_size % 3 WHEN 0 THEN 'SAMPLETON' WHEN 1 THEN 'Otherham' ELSE 'Somewhere' END AS suburb, CASE p_size % 3 WHEN 0 THEN 'Lot ' || p_partkey WHEN 1 THEN NULL END AS label, CASE p_size % 3 WHEN 0 THEN '7 Example Avenue' WHEN 1 THEN '9 Side St, Rear' END AS street FROM part")
def address_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say(F.concat(F.lit("Lot "), _k().cast("string"), F.lit(", 7 Example Avenue, SAMPLETON, nsw, 2765")), "9 Side St, Rear, Otherham, Victoria", "Somewhere")
    return _part(spark, sf_dir).select(_k().alias("id"), *[c.alias(k) for k, c in links.address_tail(line).items()])


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Ahlei Park' ELSE 'Plain (old)' END AS name, CASE WHEN p_size % 2 = 0 THEN p_size END AS available, CASE WHEN p_size % 2 = 0 THEN 110 END AS total, CASE p_size % 3 WHEN 0 THEN '12 High Street, Town' WHEN 1 THEN 'Stage 5, Town' ELSE '450000' END AS address FROM part")
def counters_and_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _say(F.concat(F.lit("Ahlei  Park ( "), _z().cast("string"), F.lit(" / 110 ) ")), "Plain (old)")
    address = _say("12 High Street, Town $450,000 Sep 2026", "Stage 5, 318.60 , Town - Q3 2026", "450000")
    return _part(spark, sf_dir).select(_k().alias("id"), *[c.alias(k) for k, c in links.counter(title).items()], links.display_address(address).alias("address"))


@query("SELECT p_partkey AS id, p_size % 4 = 0 AS column_header, p_size % 4 = 1 OR p_size % 4 = 0 AS group_header, p_size % 4 = 2 AS fragment FROM part")
def header_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _say("Lot Land Size Price Estate Name", "Aberdeen - Winter Valley", "Land $714,900", "501 2 1 1 70 Example Road $913,000")
    return _part(spark, sf_dir).select(_k().alias("id"), links.is_column_header(line).alias("column_header"), links.is_group_header(line).alias("group_header"), (links.is_price_fragment(line) & line.contains("$")).alias("fragment"))


@query("""WITH l AS (SELECT p_brand AS file, (300000 + p_partkey)::DOUBLE AS a, 250000.0::DOUBLE AS b, (550000 + p_partkey + CASE WHEN p_size % 3 = 0 THEN 1500 WHEN p_size % 3 = 1 THEN 9000 ELSE 0 END)::DOUBLE AS t FROM part),
g AS (SELECT * FROM l WHERE t - a - b <= 2000)
SELECT DISTINCT * FROM (SELECT file, 'total' AS role, t AS amount, t AS total FROM g UNION ALL SELECT file, 'component', a, t FROM g UNION ALL SELECT file, 'component', b, t FROM g)""")
def price_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.price_structure(_price_lines(spark, sf_dir), "file", "line")


@query(ORACLE_SQL["price_structure"])
def price_structure_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.price_structure(_price_lines(spark, sf_dir), "file", "line")


def _price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.when(_z() % 3 == 0, 1500).when(_z() % 3 == 1, 9000).otherwise(0)
    line = F.concat(F.lit("Lot 9 land "), _money(300000 + _k()), F.lit(" build $250,000 = $"), _money(550000 + _k() + off))
    return _part(spark, sf_dir).select(_k().alias("id"), F.col("p_brand").alias("file"), line.alias("line"))


@query("""WITH l AS (SELECT p_brand AS file, (300000 + p_partkey)::DOUBLE AS a, 250000.0::DOUBLE AS b, (550000 + p_partkey + CASE WHEN p_size % 3 = 0 THEN 1500 ELSE 0 END)::DOUBLE AS t FROM part WHERE p_size % 3 <> 1),
r AS (SELECT p_partkey AS id, p_brand AS file, CASE p_size % 4 WHEN 0 THEN 300000 + p_partkey WHEN 1 THEN 550000 + p_partkey WHEN 2 THEN 250000 ELSE 999999 END::DOUBLE AS price, p_partkey % 10 = 0 AS alone FROM part),
j AS (SELECT id, bool_or(abs(price - t) <= 2000) AS total, min(CASE WHEN abs(price - a) < 1 OR abs(price - b) < 1 THEN t END) AS fix, count(t) AS n, any_value(alone) AS alone FROM r LEFT JOIN l ON r.file = l.file GROUP BY id),
v AS (SELECT id, CASE WHEN alone THEN 'PART SOLD ALONE' WHEN n = 0 THEN 'NO EVIDENCE' WHEN total THEN 'TOTAL' WHEN fix IS NOT NULL THEN 'COMPONENT' ELSE 'NOT FOUND' END AS verdict, fix FROM j)
SELECT id, verdict, CASE WHEN verdict = 'COMPONENT' THEN fix END AS fix FROM v""")
def price_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.verify_price(_priced(spark, sf_dir), price_structure(spark, sf_dir), "file")


@query(ORACLE_SQL["price_verification"])
def price_verification_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.verify_price(_priced(spark, sf_dir), price_structure_all(spark, sf_dir), "file")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(_z() % 4 == 0, 300000 + _k()).when(_z() % 4 == 1, 550000 + _k()).when(_z() % 4 == 2, 250000).otherwise(999999).cast("double")
    return _part(spark, sf_dir).select(_k().alias("id"), F.col("p_brand").alias("file"), price.alias("price"), F.when(_k() % 10 == 0, "23 LAND ONLY").otherwise("a home").alias("text"))


@query("""SELECT id, CASE WHEN bedrooms IS NOT NULL THEN bedrooms::VARCHAR WHEN id % 4 = 0 THEN '4' END AS bedrooms, CASE WHEN land_sqm IS NOT NULL THEN NULL WHEN id % 4 = 0 THEN '450' WHEN id % 4 = 1 THEN '612.5' END AS land FROM LISTINGS""")
def rule_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(r"""SELECT * FROM VALUES ('a', 'bedrooms', r'(\d+) bdrm', 1), ('a', 'land', r'block (\d+)', 2), ('a', 'land', r'site ([\d.]+)', 3), ('b', 'land', r'site ([\d.]+)', 4), ('b', 'bedrooms', r'(\d+) bdrm', 5) AS t(cohort, field, pattern, ord)""")
    i = F.col("id")
    rows = listings(spark, sf_dir).select(i, F.when(i % 4 == 0, "a").when(i % 4 == 1, "b").otherwise("c").alias("cohort"), F.when(i % 4 == 0, "4 BDRM block 999 site 450").otherwise("99 bdrm site 612.5").alias("source_text"), F.col("bedrooms").cast("string").alias("bedrooms"), F.when(F.col("land_sqm").isNotNull(), "kept").alias("land"))
    got = ops.recover(rows, rules, ["bedrooms", "land"])
    return got.select("id", "bedrooms", F.nullif("land", F.lit("kept")).alias("land"))


@query("SELECT id, coalesce(datediff('day', (DATE '2026-06-01' + (id % 40)::INT), DATE '2026-06-30') BETWEEN 0 AND 14 AND id % 9 > 0, false) AS fresh FROM LISTINGS")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2026-06-01").cast("date"), (F.col("id") % 40).cast("int"))
    said = F.when(F.col("id") % 9 == 0, "soon").when(F.col("id") % 2 == 0, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return listings(spark, sf_dir).select("id", is_fresh(said, F.lit("2026-06-30").cast("date")).alias("fresh"))


@query("SELECT p_partkey AS id, 'lot ' || p_partkey || ' ' || lower(p_name) || ' home' AS variant FROM part")
def variant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  Lot "), _k().cast("string"), F.lit(" "), F.col("p_name"), F.lit("  home $"), _money(500000 + _z()), F.lit(" Available 12/08/2026 5.2%"))
    return _part(spark, sf_dir).select(_k().alias("id"), variant_key(line).alias("variant"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'lot 4 arklay 17' WHEN 1 THEN 'lot 5 vesper' WHEN 2 THEN 'lot 6 dune' WHEN 3 THEN 'lot 7 home' WHEN 4 THEN 'lot 8, clearwater' END AS variant FROM part")
def variant_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, dates and money that change, some cut in half, and a line that only has an address."""
    line = _say("Lot 4  Arklay 17 $ 505k Titled", "lot 5 Vesper TBC Q3 2026 avail", "Lot 6 Dune registered Sep-2", "Lot 7 home unregistered 1/9/26 quarter 2, 26 not", "")
    rows = _part(spark, sf_dir).withColumn("line", line)
    return rows.select(_k().alias("id"), F.regexp_replace(variant_key(F.col("line"), F.lit("Lot 8, Clearwater")), " not$", "").alias("variant"))


@query("SELECT p_size % 5 AS kind, count(*) AS n, count(DISTINCT p_size % 5) AS keys FROM part WHERE p_size % 5 < 4 GROUP BY 1")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spellings of one line have one key: each kind's rows alternate between them."""
    one = _say("Lot 9 $ 9 89,900 269 m2", "Lot 10 450sqm", "Lot 11 A", "Lot 12 B", "")
    two = _say("lot 9  $989,900 269", "LOT 10 450", "lot 11  a", "lot  12 b", "")
    line = F.when(_k() % 2 == 0, one).otherwise(two)
    keyed = _part(spark, sf_dir).select((_z() % 5).alias("kind"), text_key(F.lit("Mail"), line, F.lit(5.0)).alias("key")).where("key IS NOT NULL")
    return keyed.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


# --- links and pages ---
@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'floorplan_url' WHEN 1 THEN 'brochure_url' ELSE 'listing_url' END AS kind, CASE page_id % 3 WHEN 0 THEN 'floorplan' WHEN 1 THEN 'pricelist' ELSE 'brochure' END AS asset FROM pages")
def link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    anchor = _say("Site plan, floor plan", "Fact Sheet and pricing", "more", by=i)
    host = F.lit("https://example.com/")
    return p.select("page_id", links.link_kind(host, anchor).alias("kind"), links.asset_kind(anchor, host).alias("asset"))


@query("SELECT page_id, 'https://docs.example.com/d/' || page_id || CASE WHEN page_id % 2 = 0 THEN '?a=1&gid=' || (page_id % 5) ELSE '?gid=7' END AS key FROM pages")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    even = F.concat(F.lit("https://Docs.Example.com/d/"), i, F.lit("/edit?pli=1&gid="), i % 5, F.lit("&usp=sharing&a=1#gid="), i % 5)
    odd = F.concat(F.lit("HTTPS://docs.example.com/d/"), i, F.lit("/export/?utm_source=x#gid=7"))
    return table(spark, sf_dir, "pages").select("page_id", links.file_key(F.when(i % 2 == 0, even).otherwise(odd)).alias("key"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, array_to_string(array_slice(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'), -2, -1), '.') AS domain, count(*) AS n FROM pages GROUP BY 1, 2")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("n")).select("host", links.registrable(F.col("host")).alias("domain"), "n")


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT href) AS distinct_links FROM a GROUP BY 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page: the frontier of a bounded crawl over stored pages."""
    a = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("href"))
    return a.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("distinct_links"))


@query("SELECT count(*) AS pages, count(DISTINCT sha256(html)) AS contents FROM pages")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("pages"), F.count_distinct(F.sha2("html", 256)).alias("contents"))


# --- context and header runs over conversations ---
@query("""WITH c AS (SELECT *, CASE WHEN role = 'user' THEN left(text, 20) END AS h FROM conversations) SELECT conv_id, turn, last_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context, first_value(h IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS banner FROM c""")
def context_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.left("text", F.lit(20)).alias("t"))
    return places.carried(c, ["conv_id"], "turn", F.col("role") == "user", "t").select("conv_id", "turn", "context", "banner")


@query("""WITH s AS (SELECT conv_id, turn, role = 'user' AS h, lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn, sum((h AND NOT coalesce(p, false))::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s""")
def header_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.header_runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "run")
