"""Queries on places, names, attribution, channels and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..functions.values import state_of_postcode
from ..operators import channels, guards, names, places
from ..session import cut
from .catalogue import query as _query
from .listings import listings, table

QUERIES, ORACLE_SQL = {}, {}
query = lambda sql=None: _query(sql, QUERIES, ORACLE_SQL)

# --- places ---
_STATES = "['NSW', 'VIC', 'QLD', 'SA', 'WA']"
_GAZ_SQL = f"gaz AS (SELECT n_name AS suburb, ({_STATES})[(n_nationkey % 5)::INT + 1] AS state FROM nation UNION ALL SELECT r_name, ({_STATES})[(r_regionkey % 5)::INT + 1] FROM region UNION ALL SELECT 'NATION_7', 'NSW')"


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.element_at(F.array(*map(F.lit, ("NSW", "VIC", "QLD", "SA", "WA"))), (F.col(k) % 5 + 1).cast("int"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("suburb"), at("n_nationkey").alias("state"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("suburb"), at("r_regionkey").alias("state"))
    return n.unionByName(r).unionByName(spark.range(1).select(F.lit("NATION_7").alias("suburb"), F.lit("NSW").alias("state")))


_LOC_SQL = f"""
WITH {_GAZ_SQL}, raw AS (SELECT c_custkey AS id, n_name, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN n_name WHEN 2 THEN 'Stage 5A, ' || n_name WHEN 3 THEN n_name || ' | Kemps Estate' WHEN 4 THEN 'North ' || lower(n_name) || ' 2765' WHEN 5 THEN 'Rooms m2 m2' ELSE '  ' || upper(n_name) || ' (release 2)' END AS suburb,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'TAS' ELSE ({_STATES})[(n_nationkey % 5)::INT + 1] END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey),
hit AS (SELECT raw.id, min(gaz.suburb) AS name FROM raw JOIN gaz ON gaz.state = raw.state AND lower(gaz.suburb) = lower(raw.n_name) WHERE raw.id % 7 NOT IN (0, 5) GROUP BY 1)
SELECT raw.id, CASE WHEN raw.id % 7 = 0 THEN 'absent' WHEN hit.id IS NOT NULL THEN CASE WHEN raw.id % 7 = 1 THEN 'stated' ELSE 'composite' END WHEN raw.state IS NULL THEN CASE WHEN raw.id % 7 = 1 THEN 'unchecked' ELSE 'no state' END ELSE 'not a place' END AS why,
  CASE WHEN hit.id IS NOT NULL THEN hit.name WHEN raw.state IS NULL AND raw.id % 7 = 1 THEN raw.n_name END AS locality FROM raw LEFT JOIN hit ON raw.id = hit.id
"""


@query(_LOC_SQL)
def locality_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_custkey"), F.col("n_name")
    shapes = [F.lit(None).cast("string"), n, F.concat(F.lit("Stage 5A, "), n), F.concat(n, F.lit(" | Kemps Estate")), F.concat(F.lit("North "), F.lower(n), F.lit(" 2765")), F.lit("Rooms m2 m2"), F.concat(F.lit("  "), F.upper(n), F.lit(" (release 2)"))]
    state = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "TAS").otherwise(F.element_at(F.array(*map(F.lit, ("NSW", "VIC", "QLD", "SA", "WA"))), (F.col("n_nationkey") % 5 + 1).cast("int")))
    raw = c.select(k.alias("id"), F.element_at(F.array(*shapes), (k % 7 + 1).cast("int")).alias("suburb"), state.alias("state"))
    return places.with_locality(raw, gazetteer(spark, sf_dir)).select("id", "why", "locality")


_VOTE_SQL = f"""
WITH v AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'VIC' WHEN 1 THEN 'QLD' WHEN 2 THEN 'NSW' END AS post, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'VIC' ELSE 'NSW' END AS lone, c_custkey % 9 = 4 AS shared,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'VIC' WHEN 2 THEN 'QLD' ELSE 'NSW' END AS page, CASE WHEN c_custkey % 10 = 0 THEN 'SA' END AS said FROM customer),
w AS (SELECT *, CASE WHEN shared THEN NULL ELSE lone END AS sub FROM v),
x AS (SELECT *, CASE WHEN post = sub OR post = page THEN post WHEN sub = page THEN sub END AS agreed, len(list_distinct(list_filter([post, sub, page], lambda s: s IS NOT NULL))) AS d FROM w)
SELECT id, CASE WHEN said IS NOT NULL THEN said WHEN agreed IS NOT NULL THEN agreed WHEN shared AND page IN ('VIC', 'NSW') THEN page WHEN d = 1 THEN coalesce(post, sub, page) ELSE page END AS voted_state FROM x
"""


@query(_VOTE_SQL)
def state_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    post = F.when(k % 5 == 0, "3101").when(k % 5 == 1, "4207").when(k % 5 == 2, "2765")
    names_ = F.when(k % 9 == 4, F.array(F.lit("VIC"), F.lit("NSW"))).when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("VIC"))).otherwise(F.array(F.lit("NSW")))
    page = F.when(k % 4 == 1, "Victoria").when(k % 4 == 2, " qld").when(k % 4 == 3, "stock NSW list")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), post.alias("postcode"), names_.alias("suburb_states"), page.alias("page_state"), F.when(k % 10 == 0, "South Australia").alias("listing_state"))
    return places.vote_state(rows).select("id", "voted_state")


@query("WITH f AS (SELECT c_mktsegment || '-' || (c_custkey % 40) AS file, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 40 < 20 THEN 'VIC' WHEN c_nationkey % 2 = 0 THEN 'NSW' ELSE 'QLD' END AS proven FROM customer) SELECT file, count(DISTINCT proven) AS states FROM f WHERE proven IS NOT NULL GROUP BY 1 HAVING count(DISTINCT proven) > 1")
def national_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    proven = F.when(k % 3 == 0, F.lit(None)).when(k % 40 < 20, "VIC").when(F.col("c_nationkey") % 2 == 0, "NSW").otherwise("QLD")
    rows = table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_mktsegment", (k % 40).cast("string")).alias("file"), proven.alias("proven"))
    return places.national_files(rows, "file", "proven")


@query("WITH p AS (SELECT c_custkey AS id, c_custkey * 7 % 10000 AS n FROM customer) SELECT id, CASE WHEN n BETWEEN 200 AND 299 THEN 'ACT' WHEN n BETWEEN 800 AND 999 THEN 'NT' WHEN n BETWEEN 1000 AND 1999 THEN 'NSW' WHEN n BETWEEN 2600 AND 2618 OR n BETWEEN 2900 AND 2920 THEN 'ACT' WHEN n BETWEEN 2000 AND 2999 THEN 'NSW' WHEN n BETWEEN 3000 AND 3999 OR n BETWEEN 8000 AND 8999 THEN 'VIC' WHEN n BETWEEN 4000 AND 4999 OR n BETWEEN 9000 AND 9999 THEN 'QLD' WHEN n BETWEEN 5000 AND 5999 THEN 'SA' WHEN n BETWEEN 6000 AND 6999 THEN 'WA' WHEN n BETWEEN 7000 AND 7999 THEN 'TAS' END AS state FROM p")
def postcode_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), state_of_postcode(F.lpad((F.col("c_custkey") * 7 % 10000).cast("string"), 4, "0")).alias("state"))


@query(f"WITH {_GAZ_SQL} SELECT c_custkey AS id, n_name AS locality FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0")
def ngram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A locality in free text. Names of the test gazetteer hold an underscore and digits, so letters stand in for them here."""
    letters = lambda c: F.lower(F.translate(F.regexp_replace(c, "_", "-"), "0123456789", "abcdefghij"))
    n = table(spark, sf_dir, "nation")
    gaz = n.select(letters(F.col("n_name")).alias("suburb"), F.lit("NSW").alias("state"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Lot 12, 4 bed home in "), letters(F.col("n_name")), F.lit(" from $500,000"))).otherwise("no place at all")
    found = places.find_in_text(c.select(F.col("c_custkey").alias("id"), text.alias("t"), F.lit("NSW").alias("state")), gaz, "id", "t", "state")
    back = n.select(letters(F.col("n_name")).alias("locality"), F.col("n_name"))
    return found.join(F.broadcast(back), "locality").select("id", F.col("n_name").alias("locality"))


# --- names and attribution ---
@query("""WITH known AS (SELECT s_name AS name, s_suppkey AS ord FROM supplier), q AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN replace(s_name, '#', '-') WHEN 2 THEN s_name || ' X' ELSE ' ' || lower(s_name) || ' ' END AS name, s_name FROM supplier)
SELECT id, CASE WHEN id % 4 = 2 THEN name ELSE s_name END AS canonical FROM q""")
def name_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_name")
    asked = s.select(k.alias("id"), F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.regexp_replace(n, "#", "-")).when(k % 4 == 2, F.concat(n, F.lit(" X"))).otherwise(F.concat(F.lit(" "), F.lower(n), F.lit(" "))).alias("name"))
    return names.canonical(asked, s.select(n.alias("name"), k.alias("ord"))).select("id", "canonical")


@query("""WITH n AS (SELECT o_orderkey AS id, floor(o_totalprice / 200) AS p, unnest(list_distinct([(o_orderkey % 97)::DOUBLE, (o_orderkey * 7 % 89)::DOUBLE, (o_orderkey * 13 % 83)::DOUBLE, (o_custkey % 79)::DOUBLE, (o_custkey * 3 % 73)::DOUBLE, (o_orderkey % 11)::DOUBLE, (o_custkey % 13)::DOUBLE])) AS v FROM orders)
SELECT a.id AS a, b.id AS b, count(*) AS shared FROM n a JOIN n b ON a.p = b.p AND a.v = b.v AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 2""")
def fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = [k % 97, k * 7 % 89, k * 13 % 83, c % 79, c * 3 % 73, k % 11, c % 13]
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.floor(F.col("o_totalprice") / 200).alias("price"), names.numbers_of(F.concat_ws(" ", *[p.cast("string") for p in parts])).alias("numbers"))
    return names.fingerprint_matches(rows, least=2)


@query("SELECT l_suppkey, min(l_partkey % 40) AS owner, count(*) AS uses FROM lineitem WHERE l_partkey % 40 = l_suppkey % 40 OR l_suppkey % 5 > 0 GROUP BY 1 HAVING count(DISTINCT l_partkey % 40) = 1 AND count(*) >= 5")
def code_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").where((p % 40 == s % 40) | (s % 5 > 0)).select("l_suppkey", (p % 40).alias("builder"))
    return names.code_owners(rows, "l_suppkey", "builder", 5)


@query("WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'one' WHEN l_returnflag = 'A' THEN 'a' ELSE 'b' END AS label FROM lineitem), t AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS rows FROM l GROUP BY 1), e AS (SELECT l_orderkey, label, count(DISTINCT l_linenumber) AS n FROM l GROUP BY 1, 2) SELECT l_orderkey, label, rows FROM e JOIN t USING (l_orderkey) WHERE n = rows")
def file_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_orderkey") % 3 == 0, "one").when(F.col("l_returnflag") == "A", "a").otherwise("b")
    return names.file_titles(table(spark, sf_dir, "lineitem").withColumn("label", label), "l_orderkey", "l_linenumber", "label")


@query("WITH l AS (SELECT DISTINCT l_suppkey % 20 AS l, l_partkey AS k FROM lineitem), s AS (SELECT l, count(*) AS n FROM l GROUP BY 1), b AS (SELECT a.l AS a, b.l AS b, count(*) AS shared FROM l a JOIN l b ON a.k = b.k AND a.l < b.l GROUP BY 1, 2) SELECT a, b, shared FROM b JOIN s x ON x.l = a JOIN s y ON y.l = b WHERE shared >= 3 AND shared >= 0.4 * least(x.n, y.n)")
def relabel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.relabels(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("l"), "l_partkey"), "l", "l_partkey")


_EVIDENCE_SQL = "WITH e AS (SELECT l_orderkey AS id, 'flag' AS channel, l_returnflag AS answer FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, 'status', CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END FROM lineitem WHERE l_linenumber = 2)"


@query(_EVIDENCE_SQL + " SELECT id, CASE WHEN count(DISTINCT answer) = 1 THEN min(answer) END AS answer, CASE WHEN count(DISTINCT answer) = 1 THEN 'accepted' ELSE 'conflict' END AS status, array_to_string(list_sort(list_distinct(list(channel))), '+') AS channels FROM e GROUP BY 1")
def channel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    a = l.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.lit("flag").alias("channel"), F.col("l_returnflag").alias("answer"))
    b = l.where("l_linenumber = 2").select(F.col("l_orderkey").alias("id"), F.lit("status").alias("channel"), F.when(F.col("l_linestatus") == "F", "A").otherwise("N").alias("answer"))
    return names.merge_channels(a.unionByName(b))


@query("""WITH r AS (SELECT row_number() OVER () AS i, l_partkey * 100 + l_linenumber AS k, l_suppkey % 3 AS b FROM lineitem),
o AS (SELECT x.i, x.b, count(y.i) AS others, count(DISTINCT y.b) AS nb, min(y.b) AS m, count(DISTINCT y.b) FILTER (y.b <> x.b) AS foreign_b FROM r x LEFT JOIN r y ON x.k = y.k AND x.i <> y.i GROUP BY 1, 2)
SELECT count(*) AS rows, count(*) FILTER (nb = 1 AND m = b) AS recovered_right, count(*) FILTER (nb = 1 AND m <> b) AS recovered_wrong, count(*) FILTER (foreign_b = 1) AS false_positive FROM o""")
def holdout_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("k"), (F.col("l_suppkey") % 3).alias("b"))
    return names.holdout(rows, "k", "b")


@query("""WITH d AS (SELECT c_custkey AS doc_id, c_nationkey AS lot, c_mktsegment AS street FROM customer), l AS (SELECT s_suppkey AS id, s_nationkey AS lot, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS street FROM supplier),
f AS (SELECT doc_id, id, 0 AS n, 'lot and street' AS rule FROM d JOIN l USING (lot, street) UNION ALL SELECT doc_id, id, 1, 'lot' FROM d JOIN l USING (lot)),
m AS (SELECT *, min(n) OVER (PARTITION BY doc_id) AS best FROM f)
SELECT doc_id, min(id) AS listing_id, rule FROM m WHERE n = best GROUP BY doc_id, rule HAVING count(DISTINCT id) = 1""")
def brochure_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("lot"), F.col("c_mktsegment").alias("street"))
    l = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("lot"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("street"))
    return names.unique_match(d, l, [("lot and street", ["lot", "street"]), ("lot", ["lot"])])


# --- channels ---
@query("SELECT event_type, count(*) AS total, count(*) FILTER (value > 20) AS live FROM events GROUP BY 1")
def channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.counts(table(spark, sf_dir, "events"), "event_type", F.col("value") > 20)


@query("WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, strftime(max(day), '%Y-%m-%d') AS day, arg_max(n, day) AS n FROM d GROUP BY 1")
def latest_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.latest_day(table(spark, sf_dir, "events"), "event_type", F.date_format("ts", "yyyy-MM-dd"))


@query("""WITH r AS (SELECT user_id % 50 AS c, count(*) FILTER (event_type = 'view' AND user_id % 7 > 0) AS r, count(*) AS s, count(*) FILTER (event_type = 'click') * 2 AS p FROM events GROUP BY 1),
f AS (SELECT *, greatest(CASE WHEN p >= 20 THEN floor(p * 0.5) ELSE 0 END, CASE WHEN s >= 20 THEN floor(s * 0.25) ELSE 0 END)::BIGINT AS floor FROM r)
SELECT c AS channel, r AS read, floor, CASE WHEN r = 0 AND s > 0 THEN 'dead' WHEN r > 0 AND r < floor THEN 'collapsed' END AS alarm FROM f WHERE (r = 0 AND s > 0) OR (r > 0 AND r < floor)""")
def collapse_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("channel", F.col("user_id") % 50)
    per = e.groupBy("channel").agg(F.count_if((F.col("event_type") == "view") & (F.col("user_id") % 7 > 0)).alias("r"), F.count("*").alias("s"), (F.count_if(F.col("event_type") == "click") * 2).alias("p"))
    side = lambda c: per.select("channel", F.col(c).alias("n"))
    return channels.alarms(side("r"), side("s"), side("p"), "channel")


@query("SELECT user_id, count(*) AS assets, count(*) FILTER (event_type = 'purchase') AS usable FROM events GROUP BY 1")
def asset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("assets"), F.count_if(F.col("event_type") == "purchase").alias("usable"))


# --- exports ---
@query("SELECT count(*) AS rows, count(suburb) AS with_suburb, count(DISTINCT suburb) AS suburbs, round(sum(price), 2) AS total, round(median(price), 4) AS median, round(avg(price), 6) AS mean FROM LISTINGS")
def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count("suburb").alias("with_suburb"), F.count_distinct("suburb").alias("suburbs"), F.round(F.sum("price"), 2).alias("total"), F.round(F.median("price"), 4).alias("median"), F.round(F.avg("price"), 6).alias("mean")
    )


@query("SELECT coalesce(home, 'all') AS home, coalesce(availability, 'all') AS availability, count(*) AS n FROM (SELECT coalesce(home, 'none') AS home, coalesce(availability, 'none') AS availability FROM LISTINGS) GROUP BY GROUPING SETS ((home), (availability), ())")
def summary_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir).select(F.coalesce("home", F.lit("none")).alias("home"), F.coalesce("availability", F.lit("none")).alias("availability"))
    g = l.groupingSets([["home"], ["availability"], []], "home", "availability").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("home", F.lit("all")).alias("home"), F.coalesce("availability", F.lit("all")).alias("availability"), "n")


@query("SELECT row_number() OVER (ORDER BY coalesce(home, 'zz'), suburb IS NULL, lower(suburb), coalesce(price, 0), id)::INT AS place, id FROM LISTINGS QUALIFY place <= 200")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 rows of the export (a top-k report): state, rows without a name last, name, price."""
    keys = [F.coalesce("home", F.lit("zz")), F.col("suburb").isNull(), F.lower("suburb"), F.coalesce("price", F.lit(0.0)), F.col("id")]
    top = listings(spark, sf_dir).orderBy(*keys).limit(200)
    return top.select(F.row_number().over(Window.orderBy(*keys)).alias("place"), "id")


@query("SELECT row_number() OVER (ORDER BY coalesce(home, 'zz'), suburb IS NULL, lower(suburb), coalesce(price, 0), id)::BIGINT AS place, id FROM LISTINGS")
def export_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place in the export. Ranges of the keys are numbered each on its own; a range starts after the rows of those before it."""
    keys = [F.coalesce("home", F.lit("zz")), F.col("suburb").isNull(), F.lower("suburb"), F.coalesce("price", F.lit(0.0)), F.col("id")]
    # written once, so that both uses see the same ranges; the upper bits of the row's number are its range
    at = cut(listings(spark, sf_dir).orderBy(*keys).select("id", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    n = at.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = n.alias("a").join(F.broadcast(n.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return at.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"), "id")


@query("SELECT 'name' AS \"column\", count(*) AS n FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'notes', count(*) FROM customer WHERE c_custkey % 25 = 0")
def pii_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 10 == 0, F.concat(F.lit("call 03 9123 "), F.lpad((k % 10000).cast("string"), 4, "0"))).otherwise("lot 04-15-03-55-18").alias("name"),
        F.when(k % 25 == 0, F.concat(F.lit("mail a"), k.cast("string"), F.lit("@example.com"))).otherwise("code 0011091284").alias("notes"), F.lit("x@example.com").alias("brochure_url"),
    )
    return guards.contact_violations(rows)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'ask [email withheld] or [phone withheld] now' ELSE c_name END AS notes FROM customer")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), guards.redact(F.when(k % 2 == 0, F.concat(F.lit("ask a.b+c"), k.cast("string"), F.lit("@ex-ample.com.au  or 0412 345 678 now"))).otherwise(F.col("c_name"))).alias("notes"))


@query("SELECT 'benchmark without locality' AS rule, count(*) AS n FROM LISTINGS WHERE suburb IS NULL HAVING count(*) > 0")
def locality_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.violations(listings(spark, sf_dir), {"benchmark without locality": F.col("suburb").isNull(), "price below zero": F.col("price") < 0})


@query("SELECT id, (id % 3 = 0)::INT AS promo_selected FROM LISTINGS")
def promo_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir).select("id")
    return guards.mark(l, l.where("id % 3 = 0"), "id", "promo_selected")


@query("SELECT upper(suburb) AS suburb, coalesce(home, '') AS home, count(*) AS n FROM LISTINGS WHERE suburb IS NOT NULL AND home IS NOT NULL AND price > 0 AND superseded_by = '' GROUP BY ALL HAVING count(*) >= 5")
def distinct_suburbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with enough live priced rows, busiest first."""
    live = listings(spark, sf_dir).where("suburb IS NOT NULL AND home IS NOT NULL AND price > 0 AND superseded_by = ''")
    return live.groupBy(F.upper(norm(F.col("suburb"))).alias("suburb"), "home").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.col("n").desc(), "suburb", "home")
