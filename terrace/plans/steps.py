"""Queries on the small steps of a run: enrichment of blanks, counts of what a list leaves out, states and slugs of file names, confidence, marks and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from ..functions.text import storeys_count
from ..operators import audits, gates, guards, lines, score
from .catalogue import query as _query
from .listings import listings, table
from .shortlist import _GATE_SQL, BRIEF

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


def _said(*shapes: str | None, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s).cast("string") for s in shapes]), (by % len(shapes) + 1).cast("int"))


@query("""WITH o AS (SELECT p_brand, p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_type END AS kind, CASE WHEN p_size % 4 > 0 THEN p_size END AS size FROM part),
b AS (SELECT p_brand, arg_min(kind, ord) FILTER (kind <> '') AS kind, arg_min(size, ord) FILTER (size IS NOT NULL) AS size FROM o GROUP BY 1)
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 2 THEN p_name ELSE coalesce(b.kind, CASE WHEN p_partkey % 5 = 2 THEN '' END) END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE b.size END AS size FROM part LEFT JOIN b USING (p_brand)""")
def blanks_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank fields taken from the first row of the brand that has them; 0 is a value, what is stated stays."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(k.alias("id"), "p_brand", F.when(k % 5 < 2, F.col("p_name")).when(k % 5 == 2, "").alias("kind"), F.when(k % 2 == 0, 0).cast(p.schema["p_size"].dataType).alias("size"))
    other = p.select("p_brand", k.alias("ord"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_type")).alias("kind"), F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("size"))
    return lines.coalesce_fields(rows, other, "p_brand", ["kind", "size"]).select("id", "kind", "size")


@query(_GATE_SQL + "SELECT least(count(*), 100)::BIGINT AS kept, greatest(count(*) - 100, 0)::BIGINT AS truncated FROM g WHERE gate_reason IS NULL")
def candidates_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates a list of a hundred shows and how many it leaves out."""
    left = gates.gated(listings(spark, sf_dir), BRIEF).where("gate_reason IS NULL")
    return gates.capped(left, [F.col("price"), F.col("id")], 100)[1]


@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'VIC' WHEN 1 THEN 'QLD' WHEN 2 THEN 'NSW' WHEN 4 THEN 'SA' WHEN 5 THEN 'WA' END AS state, CASE p_partkey % 4 WHEN 0 THEN 'builder' WHEN 1 THEN 'g_developments' WHEN 2 THEN 'a_b_c' ELSE 'builder' END AS slug,
  CASE p_size % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 4 END AS storeys FROM part""")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that file names hold, slugs of company names, storeys as numbers."""
    k = F.col("p_partkey")
    name = _said("VIC_stock-list.xlsx", "brisbane%20qld%20list.pdf", "north.nsw.csv", "vicinity.pdf", "SA-and-WA.pdf", "wa list", "Sale act1.pdf", by=k)
    company = _said(" !! ", "G-Developments", "--A b&C--", None, by=k)
    storeys = _said("Single", " two", "TRIPLE", "2 storeys", "4", "n/a", None, by=F.col("p_size"))
    return table(spark, sf_dir, "part").select(k.alias("id"), links.file_state(name).alias("state"), links.slug(company).alias("slug"), storeys_count(storeys).alias("storeys"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'LOW' WHEN s_suppkey % 3 = 0 OR (s_suppkey % 5 = 0 AND s_suppkey % 7 = 0) THEN 'HIGH' WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 11 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM supplier""")
def supplier_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    yes = lambda n: F.when(s % n == 0, True)  # noqa: E731  what isn't known is null
    return table(spark, sf_dir, "supplier").select(s.alias("id"), score.builder_confidence(s % 2 == 1, yes(3), yes(5), yes(7), F.when(s % 11 == 0, "email_pdf").otherwise("portal")).alias("confidence"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest records (a history page, a top-k report)."""
    return audits.newest(table(spark, sf_dir, "events"), "event_id", 25).select("event_id", "user_id", "event_type")


@query("""WITH m AS (SELECT 'brand ' || p_brand AS key, count(*)::VARCHAR AS value FROM part GROUP BY 1), n AS (SELECT 'brand ' || p_brand AS key, 'large' AS value FROM part GROUP BY 1 HAVING count(*) > (SELECT avg(c) FROM (SELECT count(*) AS c FROM part GROUP BY p_brand)) UNION ALL SELECT 'rows', count(*)::VARCHAR FROM part)
SELECT coalesce(n.key, m.key) AS key, coalesce(n.value, m.value) AS value FROM m FULL JOIN n ON m.key = n.key""")
def run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key and value records of a run, those of this run over those before."""
    p = table(spark, sf_dir, "part")
    per = p.groupBy(F.concat(F.lit("brand "), "p_brand").alias("key")).agg(F.count("*").alias("n"))
    mean = per.agg(F.avg("n")).first()[0]
    new = per.where(F.col("n") > F.lit(mean)).select("key", F.lit("large").alias("value")).unionByName(p.agg(F.count("*").cast("string").alias("value")).select(F.lit("rows").alias("key"), "value"))
    return audits.set_values(per.select("key", F.col("n").cast("string").alias("value")), new)


@query("""SELECT 'folder' AS rule, count(*) FILTER (p_partkey % 4 = 0) AS n FROM part UNION ALL SELECT 'contact', count(*) FILTER (p_partkey % 6 = 1) FROM part""")
def publish_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that open a whole folder, and texts with a contact, per rule."""
    k = F.col("p_partkey")
    url = _said("https://drive.google.com/drive/folders/abc", "https://drive.google.com/file/d/1", None, "https://x.example/a.pdf", by=k)
    note = _said("fine", "mail a@b.com", "lot 7", None, "0411 22", "https://x", by=k)
    rows = table(spark, sf_dir, "part").select(url.alias("url"), note.alias("note"))
    return guards.violations(rows, {"folder": F.col("url").rlike(guards.FOLDER_LINK), "contact": guards.has_contact(F.col("note"))})
