"""Queries on sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import captures
from ..session import shared_folder
from ..sources import files
from ..streaming import ingest
from .catalogue import query as _query
from .listings import table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)


@query("SELECT page_id, 'li' AS tag, 'Lot ' || page_id || ' $' || (500 + page_id % 400) || ',000' AS card FROM pages UNION ALL SELECT page_id, 'li', 'Lot B $712,500' FROM pages")
def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    cards = F.concat(F.lit("<ul><li class=a>Lot "), i, F.lit(" <b>$"), (500 + F.col("page_id") % 400).cast("string"), F.lit(",000</b></li><li>Lot B $712,500</li></ul><p>footer</p><section>only $1,000 once</section>"))
    return files.html_cards(table(spark, sf_dir, "pages").select("page_id", F.concat("html", cards).alias("html")))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Acme' END AS builder FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 4 = 0")
def mail_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, "Sales <a@acme.example>").otherwise("x@other.example").alias("from"), F.when(k % 4 == 0, "Updated Stocklist").otherwise("hello").alias("subject"), F.when(k % 2 == 0, F.array(F.lit("list.xlsx"))).otherwise(F.array(F.lit("me.jpg"))).alias("attachments")
    )
    domains = spark.range(1).select(F.lit("acme.example").alias("domain"), F.lit("Acme").alias("builder"))
    return files.mail_rows(m, domains).select("id", "builder")


@query("SELECT c_custkey AS id, 'r1' AS row_id, 'Price' AS title, '$' || (500 + c_custkey % 400) || ',000' AS value FROM customer UNION ALL SELECT c_custkey, 'r1', 'Beds', '4' FROM customer")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.concat(F.lit("C:1=Price;C:2=Beds;D:r1/1//"), ((500 + k % 400) * 1000).cast("string"), F.lit(f"/{4644 << 12};D:r1/2/4/4/0;"))
    bodies = table(spark, sf_dir, "customer").select(k.alias("id"), body.alias("body"))
    return files.grid_cells(bodies, r"C:(\d+)=(\w+);", r"D:(\w+)/(\d+)/(\w*)/(\d*)/(\d+);")


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'pdf' WHEN 2 THEN 'refused' WHEN 3 THEN 'csv' ELSE 'unknown' END AS kind FROM customer")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    content = F.element_at(F.array(F.unhex(F.lit("504B0304")), F.lit("%PDF-1.7").cast("binary"), F.lit("  <html>").cast("binary"), F.lit("a,b\n1,2").cast("binary"), F.lit("zzz").cast("binary")), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), files.file_kind(content, F.lit("x")).alias("kind"))


_FILES = "event_id long, ts timestamp, user_id long, event_type string, value double"


@query("SELECT user_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of captures in three batches that come in no order of time, merged by user: the latest value and its time."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e.repartition(max(3, spark.sparkContext.defaultParallelism), "event_id").write.parquet(f"{root}/in")
    files = len(spark.read.parquet(f"{root}/in").inputFiles())
    per_batch = -(-files // 3)
    stream = ingest.read_captures(spark, f"{root}/in", _FILES, per_batch)
    rules = {"value": captures.STATED, "event_type": captures.FILL, "ts": captures.ALWAYS}
    ingest.upsert_stream(stream, f"{root}/table", "user_id", rules, {"value": "value_previous"}, ["ts", "event_id"], f"{root}/checkpoint", 8).awaitTermination()
    return ingest.current(spark, f"{root}/table", "user_id", rules, {"value": "value_previous"}).select("user_id", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value) END AS value, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 4 > 0 THEN event_id END AS seen FROM events),
v AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM e WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT e.user_id, arg_max(e.value, (e.ts, e.event_id)) AS value_previous FROM e JOIN v USING (user_id) WHERE e.value <> v.value GROUP BY 1),
t AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM e WHERE event_type <> '' GROUP BY 1),
a AS (SELECT user_id, seen AS last_seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1),
f AS (SELECT user_id, seen AS first_seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM e) WHERE r = 1)
SELECT user_id, value, value_previous, event_type, last_seen, first_seen FROM a JOIN f USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN p USING (user_id) LEFT JOIN t USING (user_id)""")
def stream_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream with captures that leave values out, in batches in no order of time: what each column's rule makes of all captures."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.when(i % 5 == 0, "").when(i % 5 != 1, F.col("event_type")).alias("event_type"), F.when(i % 3 != 0, F.round("value")).alias("value"), F.when(i % 4 > 0, i).alias("last_seen"), F.when(i % 4 > 0, i).alias("first_seen"),
    )
    e.repartition(max(3, spark.sparkContext.defaultParallelism), "event_id").write.parquet(f"{root}/in")
    files = len(spark.read.parquet(f"{root}/in").inputFiles())
    stream = ingest.read_captures(spark, f"{root}/in", _FILES + ", last_seen long, first_seen long", -(-files // 3))
    rules = {"value": captures.STATED, "event_type": captures.FILL, "last_seen": captures.ALWAYS, "first_seen": captures.NEVER}
    ingest.upsert_stream(stream, f"{root}/table", "user_id", rules, {"value": "value_previous"}, ["ts", "event_id"], f"{root}/checkpoint", 8).awaitTermination()
    return ingest.current(spark, f"{root}/table", "user_id", rules, {"value": "value_previous"})


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.windows(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("WITH s AS (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.windows(table(spark, sf_dir, "events"), "ts", [], "1 hour", "30 minutes")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY 1")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ingest.windows(table(spark, sf_dir, "events"), "ts", ["user_id"], "2 hours", session=True)
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("largest"))
