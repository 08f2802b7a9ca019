"""Mail with stock: who a message is from, by four rules, and the priced lines of bodies. Messages are a table; nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, clean
from ..operators import rows as stock
from ..operators.audits import mentions
from ..operators.names import canonical

# --- fixed values ---
FREE_PROVIDERS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "yahoo.com.au", "bigpond.com", "icloud.com", "me.com", "msn.com", "aol.com", "protonmail.com",
)
WORDING = r"(?i)stock\s*list|price\s*list|house\s*(?:and|&)\s*land|availability|new\s*release"
DATA = r"(?i)\.(?:xlsx?|csv|pdf)\b"
LONGEST_LINE = 400
OVER_BUDGET = 50_000
BODY_CONFIDENCE = 0.6


def _files(c: str = "attachments") -> Column:
    return F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")


def senders(messages: DataFrame, domains: DataFrame, known: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
    """messages (id, from, subject, attachments) that bring stock, with domain, builder and the rule that named it: the sender's domain is listed ('domain'); its
    first label stands in a listed domain ('label'); the subject or an attachment's name says a known company ('mention'); else the domain itself, resolved to a
    known company where it is one ('sender'). Own domains (mail is forwarded) and free providers name nobody. Without a listed domain a message needs a data
    attachment and stock wording. domains: domain, builder, ord; known: name. Ids are unique."""
    listed = domains.groupBy("domain").agg(F.min_by("builder", "ord").alias("_listed"))
    said = F.concat_ws(" ", "subject", _files())
    m = messages.withColumn("domain", F.lower(F.regexp_extract("from", r"@([\w.-]+)", 1))).join(listed, "domain", "left")
    m = m.where(F.col("_listed").isNotNull() | (_files().rlike(DATA) & said.rlike(WORDING)))
    unnamed = m.where("_listed IS NULL").select("id", "domain", said.alias("text"))
    # a label stands in a listed domain if it is one of its pieces: an equi-join, as domains are short
    size = F.length("domain")
    starts = F.explode(F.sequence(F.lit(1), size)).alias("at")
    pieces = domains.where(size > 0).select("domain", "builder", "ord", starts).select("builder", "ord", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("at") + 1), lambda n: F.substr("domain", F.col("at"), n))).alias("label"))
    by_label = pieces.groupBy("label").agg(F.min_by("builder", "ord").alias("_label"))
    labelled = unnamed.select("id", F.regexp_replace(F.split_part("domain", F.lit("."), F.lit(1)), "-", " ").alias("label")).where("label <> ''").join(by_label, "label").select("id", "_label")
    names = known.select("name").unionByName(domains.select(F.col("builder").alias("name"))).where(blank(F.col("name")).isNotNull()).distinct()
    found = mentions(unnamed.select("id", "text"), names).select("id", F.col("name").alias("_said"))
    bare = F.regexp_replace("domain", r"^[w.]+", "")  # leading letters w and dots go
    silent = F.lit(False)
    for d in (*own, *FREE_PROVIDERS):
        silent = silent | (bare == d) | bare.endswith(f".{d}")
    asked = unnamed.select("domain", bare.alias("name")).where(F.contains("name", F.lit(".")) & ~silent).distinct()
    resolved = canonical(asked, names.select("name", F.struct((-F.length("name")).alias("n"), "name").alias("ord"))).select("domain", F.col("canonical").alias("_sender"))
    rules = {"domain": "_listed", "label": "_label", "mention": "_said", "sender": "_sender"}
    named = m.join(labelled, "id", "left").join(found, "id", "left").join(resolved, "domain", "left")
    rule = F.coalesce(*[F.when(F.col(c) != "", k) for k, c in rules.items()])
    return named.select(*messages.columns, "domain", F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in rules.values()]).alias("builder"), rule.alias("rule"))


def body_listings(messages: DataFrame, since: Column, budget: float, with_rows: DataFrame | None = None) -> DataFrame:
    """id, line_no, line, the facts of ``operators.rows.FIELDS``, extraction_confidence of the priced lines of bodies, up to the budget and a little more. messages: id, sent,
    body; only those sent from ``since`` on, and not those whose attachments gave rows (``with_rows``: id). A line is one of up to 400 characters; without an
    address of its own it is its own address."""
    recent = messages.where(F.col("sent") >= since)
    if with_rows is not None:
        recent = recent.join(with_rows.select("id").distinct(), "id", "left_anti")
    lines = recent.select("id", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "line")).withColumn("line", clean(F.col("line")))
    facts = stock.with_fields(lines.where(F.length("line").between(1, LONGEST_LINE)), "line").where("price IS NOT NULL")
    kept = facts.where(F.col("price") <= budget + OVER_BUDGET)
    return kept.withColumn("lot_address", F.coalesce(blank(F.col("lot_address")), F.left("line", F.lit(110)))).withColumn("extraction_confidence", F.lit(BODY_CONFIDENCE))
