"""Queries on sheets read by typed headers and on states that rows prove."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import listing_hash
from ..operators import channels, sheets, states
from .catalogue import query as _query
from .listings import table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


@query("""SELECT p_brand AS file, p_partkey AS row, 'Lot ' || p_partkey || ' $' || printf('%,d', 300000 + p_partkey) || ' ' || (p_size * 12) || ' ' || (p_size % 15) || ' ' || (p_size % 4 + 1) || ' $' || CASE WHEN p_size % 2 = 0 THEN printf('%,d', 500000 + p_partkey) ELSE '9,500 now' END || CASE WHEN p_partkey % 3 = 0 THEN ' 800' WHEN p_partkey % 3 = 1 THEN ' $1,200' ELSE ' 1200' END AS line,
  CASE WHEN p_size % 15 BETWEEN 1 AND 12 THEN (p_size % 15)::INT END AS bedrooms, (p_size % 4 + 1)::DOUBLE AS bathrooms, CASE WHEN p_size * 12 >= 30 THEN (p_size * 12)::DOUBLE END AS land_size_sqm FROM part""")
def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet per brand under a header of two rows: bare numbers of money columns get their sign, facts keep to their bounds, a currency cell is money anywhere."""
    p, k, z = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    cells = F.array(F.concat(F.lit("Lot "), text(k)), text(300_000 + k), text(z * 12), text(z % 15), text(z % 4 + 1), F.when(z % 2 == 0, F.concat(text(500_000 + k), F.lit(".0"))).otherwise("$9,500 now"), F.when(k % 3 == 0, "800").otherwise("1200"))
    data = p.select(F.col("p_brand").alias("file"), k.alias("row"), cells.alias("cells"), F.array(*[F.lit(False)] * 6, k % 3 == 1).alias("currency"), F.lit(False).alias("head"))
    files = p.select(F.col("p_brand").alias("file")).distinct()
    head = lambda row, *labels: files.select("file", F.lit(row).cast("long").alias("row"), F.array(*map(F.lit, labels)).alias("cells"), F.lit(None).cast("array<boolean>").alias("currency"), F.lit(True).alias("head"))
    rows = data.unionByName(head(-2, "Lot", "Land", "Land", "Bedrooms", "Baths", "Package", "Yield")).unionByName(head(-1, "", "Price", "Size", "", "(beds)", "total", "extra"))
    return sheets.read_rows(rows, ["file"], "row", F.col("head")).select("file", "row", "line", "bedrooms", "bathrooms", "land_size_sqm")


_CASES = (  # suburb, estate, postcode; what it proves, by what
    ("STAGE 2 / DORA CREEK / NSW", None, None, "NSW", states.STATED), ("BRISBANE NORTH QLD", None, "3000", "QLD", states.STATED), ("Wa, x", None, None, None, None), (None, "Lot 1 / victoria", None, "VIC", states.STATED),
    ("Windermere Mambourin", None, "4207", "VIC", states.LOCALITY), ("Warralily Armstrong Creek", None, None, None, None), ("Warralily Armstrong Creek", None, "3217", "VIC", states.BOTH), ("Estate, Armstrong Creek", None, "4520", "QLD", states.BOTH), ("Armstrong Creek", None, "4520", "QLD", states.BOTH),
    ("CITY OF LOGAN", None, "3000", None, None), ("Mambourin", None, None, None, None), ("Mambourin", None, "3024", "VIC", states.WHOLE), ("Mambourin", None, "4207", None, None), (None, "Redbank Plains Eden", None, None, None), ("Plot", "Highfields / Eden", None, "NSW", states.LOCALITY), ("", None, "2259", None, None),
)


@query("SELECT c_custkey AS id, c.own_state, c.proof FROM customer JOIN (VALUES " + ", ".join(f"({i}, {s!r}, {p!r})".replace("None", "NULL") for i, (*_, s, p) in enumerate(_CASES)) + f") c(i, own_state, proof) ON c.i = c_custkey % {len(_CASES)}")
def proven_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row proves of its state: stated, by a locality, by a locality and a postcode that agree, or not at all."""
    at = lambda n: F.element_at(F.array(*[F.lit(c[n]).cast("string") for c in _CASES]), (F.col("c_custkey") % len(_CASES) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), at(0).alias("suburb"), at(1).alias("estate_name"), F.lit(None).cast("string").alias("lot_address"), at(2).alias("postcode"))
    gaz = spark.createDataFrame([("Dora Creek", "NSW"), ("Mambourin", "VIC"), ("Armstrong Creek", "VIC"), ("Armstrong Creek", "QLD"), ("Logan", "VIC"), ("Eden", "NSW")], "suburb string, state string")
    return states.proven_states(rows, gaz)


@query("""SELECT p_partkey AS id, 'v2:' || sha256('source_channel=' || CASE p_partkey % 2 WHEN 0 THEN 'portal' ELSE '' END || '|attribution_scope=builder|builder_key=' || lower(p_type) || '|suburb_norm=' || lower(p_brand) || '|lot_number=' || (p_partkey % 40) || '|house_design=' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 'vesper' END
  || '|land_sqm=' || CASE WHEN p_size % 5 = 0 THEN '' ELSE (p_size * 10) || '.0' END || '|variant_key=lot ' || (p_partkey % 40) || CASE WHEN p_size % 3 = 0 THEN ' arklay 17' ELSE '' END || CASE WHEN p_partkey % 4 > 0 THEN '|variant_ordinal=' || (p_partkey % 4) ELSE '' END) AS content_hash FROM part""")
def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities over all eight fields; prices, statuses and dates in the line make no difference."""
    k, z = F.col("p_partkey"), F.col("p_size")
    lot = (k % 40).cast("string")
    line = F.when(z % 3 == 0, F.concat(F.lit("Lot  "), lot, F.lit(" Arklay 17 $"), F.format_number(500_000 + k, 0), F.lit(" Available Q3 2026")))
    parts = F.when(k % 2 == 0, " Portal").otherwise(""), F.lit("builder"), F.col("p_type"), F.col("p_brand"), lot, F.when(z % 3 != 0, "VESPER"), F.when(z % 5 == 0, 0).otherwise(z * 10), line, F.concat(F.lit("Lot "), lot, F.lit(" SOLD")), k % 4
    return table(spark, sf_dir, "part").select(k.alias("id"), listing_hash(*parts).alias("content_hash"))


@query("""WITH e AS (SELECT event_type || (user_id % 3) AS channel, ts::DATE AS day FROM events WHERE NOT (user_id % 3 = 1 AND day(ts) % 4 = 0) AND NOT (user_id % 3 = 2 AND day(ts) % 5 < 2 AND event_id % 10 > 0)),
n AS (SELECT channel, day, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT channel, min(day) AS first FROM n GROUP BY 1), d AS (SELECT channel, unnest(generate_series(first, (SELECT max(day) FROM n), INTERVAL 1 DAY))::DATE AS day FROM f),
j AS (SELECT channel, day, coalesce(n, 0) AS read, coalesce(lag(coalesce(n, 0)) OVER w, 0) AS previous, coalesce(sum(coalesce(n, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stored FROM d LEFT JOIN n USING (channel, day) WINDOW w AS (PARTITION BY channel ORDER BY day)),
a AS (SELECT *, greatest(CASE WHEN previous >= 20 THEN floor(previous * 0.5) ELSE 0 END, CASE WHEN stored >= 20 THEN floor(stored * 0.25) ELSE 0 END)::BIGINT AS floor FROM j)
SELECT channel, strftime(day, '%Y-%m-%d') AS day, read, floor, CASE WHEN read = 0 THEN 'dead' ELSE 'collapsed' END AS alarm FROM a WHERE (read = 0 AND stored > 0) OR (read > 0 AND read < floor)""")
def daily_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a channel was silent or collapsed, each judged by what was known then."""
    u, day = F.col("user_id"), F.dayofmonth("ts")
    e = table(spark, sf_dir, "events").where(~((u % 3 == 1) & (day % 4 == 0)) & ~((u % 3 == 2) & (day % 5 < 2) & (F.col("event_id") % 10 > 0)))
    rows = e.select(F.concat("event_type", (u % 3).cast("string")).alias("channel"), F.to_date("ts").alias("day"))
    last = rows.agg(F.max("day")).first()[0]
    return channels.daily_alarms(rows, "channel", F.col("day"), F.lit(last)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
