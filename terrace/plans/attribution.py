"""Queries on who a row belongs to: keys of pooled rows, their measures, the names they give; brochures by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brochures, pooled
from .catalogue import query as _query
from .listings import table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)

_DESIGNS = ("Vesper", "Tuvala", "SODIUM", "Marlow", "Kestrel")


def _stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A priced line per part. Its company goes with its land; its design mostly does."""
    k, z = F.col("p_partkey"), F.col("p_size")
    price, lot, land, beds = 500_000 + 1000 * (k % 50), (k % 7 + 10).cast("string"), 300 + 10 * (z % 4), z % 3 + 2
    design = F.element_at(F.array(*map(F.lit, _DESIGNS)), (F.when(k % 10 == 0, 4).otherwise(z % 4) + 1).cast("int"))
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    text = F.concat_ws(" ", F.lit("Lot"), lot, design, F.lit("facade on"), land.cast("string"), F.lit("sqm with"), beds.cast("string"), F.lit("beds"), money(price - 200_000), F.lit("$200,000"), money(price), F.lit("Available"))
    split = k % 3 != 0
    return table(spark, sf_dir, "part").select(
        k.alias("id"), price.cast("double").alias("price"), lot.alias("lot_number"), land.cast("double").alias("land_sqm"), F.when(split, price - 200_000).cast("double").alias("land_price"), F.when(split, 200_000.0).alias("build_price"),
        F.col("p_brand").alias("suburb"), text.alias("source_text"), F.when(k % 4 != 0, F.concat(F.lit("b"), (z % 4).cast("string"))).alias("builder"),
    )


#: The same, said by parts: rows of one key agree in these.
_KEYS_SQL = """
WITH s AS (SELECT p_partkey AS id, 500000 + 1000 * (p_partkey % 50) AS price, p_partkey % 7 AS lot, p_size % 4 AS land, p_size % 3 AS beds, CASE WHEN p_partkey % 10 = 0 THEN 4 ELSE p_size % 4 END AS design, p_partkey % 3 <> 0 AS split, CASE WHEN p_partkey % 4 <> 0 THEN 'b' || (p_size % 4) END AS builder FROM part),
a AS (SELECT id, builder, unnest(['price_lot', 'price_land', 'text', 'amounts', 'price_suburb', 'price', 'design', 'design_often', CASE WHEN split THEN 'price_parts' END]) AS kind, unnest([price || '|' || lot, price || '|' || land, lot || '|' || design || '|' || land || '|' || beds, price::VARCHAR, price::VARCHAR, price::VARCHAR, design::VARCHAR, design::VARCHAR, price::VARCHAR]) AS key FROM s),
k AS (SELECT * FROM a WHERE kind IS NOT NULL AND builder IS NOT NULL),
per AS (SELECT kind, key, builder, count(*) AS n FROM k GROUP BY ALL),
tot AS (SELECT kind, key, count(*) AS nb, min(builder) AS lo, max(builder) AS hi FROM per GROUP BY ALL),
own AS (SELECT k.id, k.kind, k.builder, per.n, tot.nb, CASE WHEN tot.lo = k.builder THEN tot.hi ELSE tot.lo END AS other, CASE k.kind WHEN 'design' THEN 1 WHEN 'design_often' THEN 10 END AS floor FROM k JOIN per USING (kind, key, builder) JOIN tot USING (kind, key)),
o AS (SELECT own.*, coalesce((SELECT p.n FROM per p JOIN k USING (kind, key) WHERE k.id = own.id AND k.kind = own.kind AND p.builder = own.other LIMIT 1), 0) AS other_n FROM own),
j AS (SELECT *, nb - (n = 1)::INT AS left_a, CASE WHEN n = 1 THEN other_n ELSE n - 1 END AS n_a, nb - 1 AS left_b FROM o),
m AS (SELECT *, CASE WHEN floor IS NULL THEN left_a WHEN left_a = 1 AND n_a >= floor THEN 1 ELSE 0 END AS got_a, CASE WHEN floor IS NULL THEN left_b WHEN left_b = 1 AND other_n >= floor THEN 1 ELSE 0 END AS got_b FROM j),
near AS (SELECT x.id, x.builder, y.builder AS other FROM s x JOIN s y ON x.price = y.price AND x.lot = y.lot AND x.land = y.land AND x.beds = y.beds AND x.id <> y.id WHERE y.builder IS NOT NULL),
num AS (SELECT id, builder, count(DISTINCT other) AS got_a, min(other) AS answer, count(DISTINCT other) FILTER (other <> builder) AS got_b FROM near WHERE builder IS NOT NULL GROUP BY 1, 2),
kinds AS (SELECT unnest(['price_lot', 'price_land', 'text', 'amounts', 'price_parts', 'price_suburb', 'price', 'design', 'design_often', 'numbers']) AS kind),
sums AS (SELECT kind, count(*) FILTER (got_a = 1) AS answered, count(*) FILTER (got_a = 1 AND n > 1) AS good, count(*) FILTER (got_a > 1) AS ambiguous, count(*) FILTER (got_b = 1) AS invented FROM m GROUP BY 1
  UNION ALL SELECT 'numbers', count(*) FILTER (got_a = 1), count(*) FILTER (got_a = 1 AND answer = builder), count(*) FILTER (got_a > 1), count(*) FILTER (got_b = 1) FROM num),
measured AS (SELECT kind, (SELECT count(*) FROM s WHERE builder IS NOT NULL) AS rows, coalesce(answered, 0) AS answered, coalesce(good, 0) AS "right", coalesce(answered - good, 0) AS wrong, coalesce(ambiguous, 0) AS ambiguous, coalesce(invented, 0) AS invented, CASE WHEN answered > 0 THEN good / answered END AS precision FROM kinds LEFT JOIN sums USING (kind)),
judged AS (SELECT *, coalesce(precision >= 0.99, false) AND invented <= 0.01 * rows AS trusted FROM measured)
"""


@query(_KEYS_SQL + "SELECT * FROM judged")
def pooled_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of key held out over the named rows: what it recovers, and whom it invents."""
    stock = _stock(spark, sf_dir)
    return pooled.measure(stock, stock.where("builder IS NOT NULL").select("id", "builder"), pooled.place_words(stock, ["suburb"]))


@query(_KEYS_SQL + """, said AS (SELECT a.id, a.kind, per.builder FROM a JOIN per USING (kind, key) WHERE a.builder IS NULL AND a.kind NOT LIKE 'design%'
  UNION ALL SELECT a.id, a.kind, per.builder FROM a JOIN per USING (kind, key) JOIN tot USING (kind, key) WHERE a.builder IS NULL AND tot.nb = 1 AND (a.kind = 'design' OR a.kind = 'design_often' AND per.n >= 10)
  UNION ALL SELECT id, 'numbers', other FROM near WHERE builder IS NULL)
SELECT id, CASE WHEN count(DISTINCT builder) = 1 THEN min(builder) END AS builder, CASE WHEN count(DISTINCT builder) = 1 THEN 'accepted' ELSE 'conflict' END AS status, array_to_string(list_sort(list(DISTINCT kind)), '+') AS kinds FROM said WHERE kind IN (SELECT kind FROM judged WHERE trusted) GROUP BY id""")
def pooled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rows named by the kinds of keys that the measures trust."""
    stock = _stock(spark, sf_dir)
    named, places = stock.where("builder IS NOT NULL"), pooled.place_words(stock, ["suburb"])
    trusted = [r.kind for r in pooled.measure(stock, named.select("id", "builder"), places).where("trusted").collect()]  # ten kinds at most
    return pooled.name_rows(stock.where("builder IS NULL").drop("builder"), named.drop("builder"), named.select("id", "builder"), trusted, places)


@query("""WITH l AS (SELECT s_suppkey AS id, 'B' || (s_suppkey % 4) AS b, s_suppkey % 90 AS lot, (s_suppkey % 30) || ' high street' AS address, s_suppkey % 13 AS w FROM supplier),
d AS (SELECT c_custkey AS id, 'B' || (c_custkey // 4 % 4) AS b, c_custkey % 45 AS lot, (c_custkey % 33) || ' high' AS street, c_custkey % 14 AS w, c_custkey % 4 AS shape FROM customer),
size AS (SELECT b, count(*) AS n FROM l GROUP BY 1), often AS (SELECT b, w, count(*) AS n FROM l GROUP BY 1, 2)
SELECT d.id AS doc_id, min(l.id) AS listing_id, 'lot' AS rule FROM d JOIN l USING (b, lot) WHERE shape = 0 AND d.lot > 0 GROUP BY 1 HAVING count(*) = 1
UNION ALL SELECT d.id, min(l.id), 'street' FROM d JOIN l ON d.b = l.b AND contains(l.address, d.street) WHERE shape = 1 GROUP BY 1 HAVING count(*) = 1
UNION ALL SELECT d.id, l.id, 'design' FROM d JOIN l USING (b, w) JOIN often o USING (b, w) JOIN size USING (b) WHERE shape = 2 AND o.n <= greatest(3, size.n // 4)
UNION ALL SELECT d.id, min(l.id), 'lot and word' FROM d JOIN l USING (lot, w) WHERE shape = 3 AND d.lot > 0 GROUP BY 1 HAVING count(*) = 1""")
def brochure_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of customers by lot, street or design of a company's suppliers, and files of nobody by lot and word."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    word = lambda n: F.repeat(F.char(97 + n), F.lit(5))
    lot, at = (c % 45).cast("string"), c % 4
    name = F.when(at == 0, F.concat(F.lit("Lot "), lot, F.lit(".pdf"))).when(at == 1, F.concat((c % 33).cast("string"), F.lit(" High Road flyer.pdf"))).when(at == 2, F.concat(F.lit("draft "), word(c % 14), F.lit(" x.pdf"))).otherwise(F.concat(F.lit("Lot 0"), lot, F.lit(" "), word(c % 14), F.lit(".pdf")))
    docs = table(spark, sf_dir, "customer").select(c.alias("doc_id"), F.when(at != 3, F.concat(F.lit("b"), (F.floor(c / 4) % 4).cast("string"))).alias("builder"), name.alias("filename"))
    listings = table(spark, sf_dir, "supplier").select(
        s.alias("id"), F.concat(F.lit("B"), (s % 4).cast("string")).alias("builder"), (s % 90).cast("string").alias("lot_number"), F.concat((s % 30).cast("string"), F.lit(" High Street")).alias("lot_address"), F.lit(None).cast("string").alias("suburb"),
        F.lit(None).cast("string").alias("estate_name"), F.concat(F.lit("Lot of "), F.upper(word(s % 13))).alias("source_text"),
    )
    return brochures.match(docs, listings)
