"""Queries on repairs, enrichment, routing, briefs and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names, repairs, research
from .catalogue import query as _query
from .listings import listings, table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


@query("SELECT p_partkey AS id, CASE WHEN p_size <= 12 THEN p_size END AS bedrooms, CASE WHEN p_size * 2 < 40 THEN NULL ELSE p_size * 2.0 END::DOUBLE AS house_sqm, CASE WHEN p_partkey % 2 = 0 THEN 'http://x' END AS brochure_url FROM part")
def impossible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("bedrooms"), (F.col("p_size") * 2.0).cast("double").alias("house_sqm"), F.when(F.col("p_partkey") % 2 == 0, "http://x").otherwise(" ").alias("brochure_url"))
    return repairs.null_impossible(p)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN suburb IS NULL THEN 'not stated' ELSE suburb END AS builder_name, CASE WHEN id % 3 = 0 THEN suburb END AS developer_name FROM LISTINGS")
def project_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir).select("id", F.col("suburb").alias("builder_name"), F.when(F.col("id") % 3 == 0, "project").otherwise("builder").alias("attribution_scope"))
    return repairs.project_names(l).select("id", "builder_name", "developer_name")


@query("""WITH r AS (SELECT id, suburb || '/' || (id % 40) AS t, bedrooms AS b, land_sqm AS l, id % 50 AS seen FROM LISTINGS WHERE suburb IS NOT NULL),
k AS (SELECT *, first_value(id) OVER w AS keeper, first_value(b) OVER w AS kb, first_value(l) OVER w AS kl FROM r WINDOW w AS (PARTITION BY t ORDER BY (b IS NOT NULL)::INT * 2 + (l IS NOT NULL)::INT DESC, seen DESC, id))
SELECT id, keeper FROM k WHERE id <> keeper AND (b IS NULL OR b IS NOT DISTINCT FROM kb) AND (l IS NULL OR l IS NOT DISTINCT FROM kl)""")
def subsumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir).where("suburb IS NOT NULL").select("id", F.concat_ws("/", "suburb", (F.col("id") % 40).cast("string")).alias("t"), "bedrooms", "land_sqm", (F.col("id") % 50).alias("last_seen"))
    return repairs.duplicates_by_text(l, "t", {"bedrooms": 2, "land_sqm": 1}, ["bedrooms", "land_sqm"])


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 4 AS b FROM supplier WHERE s_suppkey % 12 < 8), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(label, c) AS (SELECT a, a FROM d UNION SELECT d.a, w.c FROM w JOIN d ON d.b = w.label)
SELECT label, min(c) AS class FROM w GROUP BY 1""")
def relabel_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 12 < 8").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 4).alias("b"))
    return repairs.label_classes(s)


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'QLD' WHEN 1 THEN 'NSW' WHEN 3 THEN 'VIC' END AS own FROM customer")
def own_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "KEARNEYS SPRING / qld").when(k % 4 == 1, "Lot 5, austral | 3 bed").when(k % 4 == 2, "Denman, 4 bed").otherwise("Stage 2, Victoria, Denman")
    local = F.create_map(F.lit("austral"), F.array(F.lit("NSW")), F.lit("denman"), F.array(F.lit("NSW"), F.lit("QLD")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), repairs.own_state(text, local).alias("own"))


@query("SELECT c_custkey % 20 AS file, c_custkey AS row, 0 AS at, 'lot number' AS label, c_name AS value FROM customer UNION ALL SELECT c_custkey % 20, c_custkey, 1, 'price', c_mktsegment FROM customer")
def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    data = c.select((k % 20).alias("file"), k.alias("row"), F.array("c_name", "c_mktsegment").alias("cells"), F.lit(False).alias("head"))
    heads = c.select((k % 20).alias("file")).distinct()
    top = heads.select("file", F.lit(-2).cast("long").alias("row"), F.array(F.lit("Lot"), F.lit("Price")).alias("cells"), F.lit(True).alias("head"))
    more = heads.select("file", F.lit(-1).cast("long").alias("row"), F.array(F.lit("Number"), F.lit("")).alias("cells"), F.lit(True).alias("head"))
    return repairs.header_columns(data.unionByName(top).unionByName(more), ["file"], "row", F.col("head"))


@query("SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'lot_url' WHEN page_id % 3 = 0 THEN NULL ELSE 'list_url' END AS primary_kind, CASE WHEN page_id % 2 = 0 THEN 'https://lot/' || page_id WHEN page_id % 3 = 0 THEN NULL ELSE 'http://list' END AS primary_url, (page_id % 2 = 0)::INT + (page_id % 3 <> 0)::INT AS n_links FROM pages")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(i.alias("id"), F.when(i % 2 == 0, F.concat(F.lit("https://lot/"), i)).alias("lot_url"), F.when(i % 3 != 0, "http://list").otherwise("mailto:x").alias("list_url"), F.when(i % 3 != 0, " http://list ").alias("document_url"))
    out = repairs.source_links(p, {"lot_url": 0, "list_url": 2, "document_url": 4})
    return out.select("id", "primary_kind", "primary_url", F.when(F.col("primary_url").isNull(), 0).otherwise(F.col("n_links")).alias("n_links"))


@query("SELECT coalesce(o.k, n.k) AS k, CASE WHEN coalesce(n.name, '') <> '' THEN n.name ELSE o.name END AS name, greatest(coalesce(o.flag, 0), coalesce(n.flag, 0)) AS flag FROM (SELECT s_suppkey AS k, s_name AS name, (s_suppkey % 2)::INT AS flag FROM supplier) o FULL JOIN (SELECT s_suppkey + 50 AS k, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'new ' || s_name END AS name, (s_suppkey % 5 = 0)::INT AS flag FROM supplier) n ON o.k = n.k")
def directory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    old = s.select(k.alias("k"), F.col("s_name").alias("name"), (k % 2).cast("int").alias("flag"))
    new = s.select((k + 50).alias("k"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("new "), F.col("s_name"))).alias("name"), (k % 5 == 0).cast("int").alias("flag"))
    return repairs.directory_upsert(old, new, "k", ["name"], ["flag"])


@query("SELECT page_id AS id, CASE WHEN url LIKE '%example.org%' THEN 'org' WHEN url LIKE '%://m.%.example.com%' OR url LIKE '%example.com%' THEN 'com' ELSE 'unsupported' END AS handler FROM pages")
def handler_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    handlers = spark.range(1).select(F.explode(F.array(F.struct(F.lit("example.org").alias("domain"), F.lit("org").alias("handler")), F.struct(F.lit("example.com").alias("domain"), F.lit("com").alias("handler")))).alias("h")).select("h.*")
    return repairs.route(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), handlers).select("id", "handler")


@query("""WITH l AS (SELECT 'n' || n_nationkey AS src, 'n' || ((n_nationkey * 3 + 1) % 25) AS dst FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 2) % 25) FROM nation), d1 AS (SELECT DISTINCT dst AS url FROM l WHERE src = 'n0' AND dst <> 'n0'), d2 AS (SELECT DISTINCT dst AS url FROM l WHERE src IN (SELECT url FROM d1) AND dst <> 'n0' AND dst NOT IN (SELECT url FROM d1))
SELECT 'n0' AS url, 0 AS depth UNION ALL SELECT url, 1 FROM d1 UNION ALL SELECT url, 2 FROM d2""")
def bounded_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    page = lambda x: F.concat(F.lit("n"), x.cast("string"))
    links = n.select(page(k).alias("src"), page((k * 3 + 1) % 25).alias("dst")).union(n.select(page(k), page((k * 7 + 2) % 25)))
    return repairs.crawl(links, spark.range(1).select(F.lit("n0").alias("url")), 2, 100)


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 850000 WHEN 1 THEN 900000 ELSE 0 END::DOUBLE AS budget, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END::BIGINT AS bedrooms_min, CASE c_custkey % 3 WHEN 0 THEN 'Investor' WHEN 1 THEN 'Owner Occupier' ELSE 'First Home Buyer' END AS buyer, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_suburbs FROM customer")
def brief_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs as untrusted JSON: numbers in any form, lists as lists or text, no invented minimum."""
    k = F.col("c_custkey")
    budget = F.when(k % 4 == 0, '"$850,000"').when(k % 4 == 1, "900000").when(k % 4 == 2, '"NaN"').otherwise('"1e400"')
    text = F.concat(F.lit('{"budget_max": '), budget, F.lit(', "bedrooms_min": '), F.when(k % 4 == 0, '"3"').otherwise('"lots"'), F.lit(', "buyer_type": "'), F.when(k % 3 == 0, "An INVESTOR").when(k % 3 == 1, "Owner occupier").otherwise("first home buyer"), F.lit('", "primary_suburbs": '), F.when(k % 2 == 0, '"Austral, Denman"').otherwise('["Austral"]'), F.lit("}"))
    b = research.parse_briefs(table(spark, sf_dir, "customer").select(k.alias("id"), text.alias("brief")), "brief")
    return b.select("id", F.col("budget_max").alias("budget"), "bedrooms_min", F.col("buyer_type").alias("buyer"), F.size("primary_suburbs").alias("n_suburbs"))


@query("SELECT id, '{\"name\":\"Lot ' || id || '\",\"price\":' || (id * 10) || '}' AS payload FROM LISTINGS")
def crm_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return listings(spark, sf_dir).select("id", F.to_json(F.struct(F.concat(F.lit("Lot "), i.cast("string")).alias("name"), (i * 10).alias("price"))).alias("payload"))


@query("SELECT id, '{\"name\":\"Lot ' || id || '\",\"price\":' || (id * 10) || '}' AS payload FROM LISTINGS")
def crm_payload_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return listings(spark, sf_dir).select("id", F.to_json(F.struct(F.concat(F.lit("Lot "), i.cast("string")).alias("name"), (i * 10).alias("price"))).alias("payload"))


@query("""WITH g AS (SELECT *, CASE WHEN superseded_by <> '' THEN 'superseded' WHEN home IS NULL THEN 'state unknown' WHEN price > 2000 THEN 'over ceiling' END AS reason FROM LISTINGS)
SELECT 'run' AS record, NULL AS reason, count(*) AS n FROM g UNION ALL SELECT 'candidates', NULL, count(*) FROM g WHERE reason IS NULL UNION ALL SELECT 'rejections', reason, count(*) FROM g WHERE reason IS NOT NULL GROUP BY reason""")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three audit records of a run from one scan."""
    reason = F.when(F.col("superseded_by") != "", "superseded").when(F.col("home").isNull(), "state unknown").when(F.col("price") > 2000, "over ceiling")
    per = listings(spark, sf_dir).select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    records = F.array(F.struct(F.lit("run").alias("record"), F.lit(None).cast("string").alias("r")), F.when(F.col("reason").isNull(), F.struct(F.lit("candidates").alias("record"), F.lit(None).cast("string").alias("r"))).otherwise(F.struct(F.lit("rejections").alias("record"), F.col("reason").alias("r"))))
    return per.select(F.explode(records).alias("x"), "n").groupBy(F.col("x.record").alias("record"), F.col("x.r").alias("reason")).agg(F.sum("n").alias("n"))


@query("SELECT id, coalesce(market, internal) AS points, CASE WHEN market IS NOT NULL THEN 'market' WHEN internal IS NOT NULL THEN 'internal' ELSE 'none' END AS basis FROM (SELECT id, CASE id % 4 WHEN 0 THEN 15.0 WHEN 1 THEN 12.5 END::DOUBLE AS market, CASE WHEN id % 3 = 0 THEN 11.0 END::DOUBLE AS internal FROM LISTINGS)")
def benchmark_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    l = listings(spark, sf_dir).select("id", F.when(i % 4 == 0, 15.0).when(i % 4 == 1, 12.5).alias("m"), F.when(i % 3 == 0, 11.0).alias("n"))
    both = F.coalesce(F.when(F.col("m").isNotNull(), F.struct(F.col("m").alias("points"), F.lit("market").alias("basis"))), F.when(F.col("n").isNotNull(), F.struct(F.col("n").alias("points"), F.lit("internal").alias("basis"))))
    return l.select("id", both["points"].alias("points"), F.coalesce(both["basis"], F.lit("none")).alias("basis"))


@query("WITH a AS (SELECT conv_id, turn, turn * 10.0 AS y FROM conversations), l AS (SELECT conv_id, turn, turn * 10.0 + CASE WHEN turn % 2 = 0 THEN 1.5 ELSE 4 END AS y FROM conversations) SELECT a.conv_id, a.turn, count(*) AS links FROM a JOIN l ON a.conv_id = l.conv_id AND abs(a.y - l.y) <= 2 GROUP BY 1, 2")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and links of a page at the same height, within two units: an equi-join on the page and neighbouring bands."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", (F.col("turn") * 10.0).alias("y")).withColumn("band", F.explode(F.array(*[F.floor(F.col("y") / 2) + d for d in (-1, 0, 1)])))
    l = c.select("conv_id", (F.col("turn") * 10.0 + F.when(F.col("turn") % 2 == 0, 1.5).otherwise(4.0)).alias("ly")).withColumn("band", F.floor(F.col("ly") / 2))
    return a.join(l, ["conv_id", "band"]).where(F.abs(F.col("y") - F.col("ly")) <= 2).groupBy("conv_id", "turn").agg(F.count("*").alias("links"))


@query("SELECT s_suppkey AS id, NOT (s_suppkey % 3 = 0) AS company FROM supplier")
def not_a_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Stage "), k.cast("string"))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (~name.rlike(names.NOT_A_COMPANY)).alias("company"))
