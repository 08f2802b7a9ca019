"""A research run: untrusted briefs to typed columns, the stored benchmark where the market has none, each record's payload, and the tables that keep the run.

Defined results: a brief that is no JSON object, is null or empty has every default; a record without candidates still has a payload and a run row; equal
scores keep the order of ids; candidates of a record that has no brief are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import number

# --- fixed values: what a brief may hold, with the value that stands where nothing usable is stated ---
AMOUNTS = {"budget_max": 0.0, "deposit_amount": 0.0, "land_size_min_sqm": 0.0, "house_size_min_sqm": 0.0, "target_rent_weekly": None, "target_gross_yield_pct": None, "search_radius_km": None}
COUNTS = {"bedrooms_min": 0, "bathrooms_min": 0, "car_spaces_min": 0, "storeys_max": None, "build_timeframe_months": None}
TEXTS = {"client_name": "Unnamed Client", "finance_status": "Pre-approved", "state": "QLD", "additional_notes": ""}
LISTS = ("primary_suburbs", "secondary_suburbs", "must_have_features", "nice_to_have_features", "excluded_suburbs", "preferred_builders")
BUYERS = (("first", "First Home Buyer"), ("invest", "Investor"), ("smsf", "SMSF"))
OTHER_BUYER = "Owner Occupier"
#: Points of a comparison with stock that is held, by its variance in percent; below the market's own full marks.
INTERNAL_POINTS = ((-5.0, 12.5, False), (5.0, 11.0, True), (12.0, 9.0, True))
INTERNAL_ELSE, UNKNOWN_POINTS = 5.0, 7.5
STATUS = "Awaiting Consultant Review"
NOBODY = "No qualifying properties found"
# --- ---
SCALAR = "^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _list(brief: Column, name: str) -> Column:
    """A list of trimmed, non-empty texts from a list, or from one bare value, of which commas part a text; whatever else is in it goes."""
    path = f"$.{name}"
    items = F.filter(F.try_variant_get(brief, path, "array<variant>"), lambda x: F.schema_of_variant(x).rlike(SCALAR))
    listed = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    value = F.try_variant_get(brief, path, "variant")
    kind = F.schema_of_variant(value)
    bare = F.when(kind == "STRING", F.split(F.try_variant_get(brief, path, "string"), ",")).when(kind.rlike(SCALAR) & (kind != "BOOLEAN"), F.array(F.try_variant_get(brief, path, "string")))
    return F.filter(F.transform(F.coalesce(listed, bare, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def parse_briefs(df: DataFrame, brief: str) -> DataFrame:
    """df with the typed columns of its JSON briefs in place of ``brief``. Numbers are read in any form and have to be finite; no minimum and no cap is
    invented; the buyer's type is told by what its text contains."""
    v = F.col("_brief")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    or_else = lambda c, value, t: (F.coalesce(c, F.lit(value)) if value is not None else c).cast(t)
    amount = {c: or_else(number(text(c)), d, "double") for c, d in AMOUNTS.items()}
    amount["preferred_spending_cap"] = F.coalesce(number(text("preferred_spending_cap")), amount["budget_max"])
    count = {c: or_else(number(text(c)).cast("long"), d, "long") for c, d in COUNTS.items()}
    said = lambda c: F.when(~text(c).isin("", "false", "0"), text(c))
    texts = {c: F.coalesce(said(c), F.lit(d)) for c, d in TEXTS.items()}
    texts["state"] = F.upper(texts["state"])
    buyer, kind = F.lower(F.coalesce(text("buyer_type"), F.lit(""))), F.lit(OTHER_BUYER)
    for part, name in reversed(BUYERS):
        kind = F.when(buyer.contains(part), name).otherwise(kind)
    new = texts | amount | count | {"buyer_type": kind} | {c: _list(v, c) for c in LISTS}
    kept = [c for c in df.columns if c != brief and c.lower() not in new]
    return df.withColumn("_brief", F.try_parse_json(F.col(brief))).select(*kept, *[c.alias(n) for n, c in new.items()])


def internal_points(variance: Column) -> Column:
    """Points of an internal comparison; unknown is neutral."""
    out = F.lit(INTERNAL_ELSE)
    for edge, points, closed in reversed(INTERNAL_POINTS):
        out = F.when((variance <= edge) if closed else (variance < edge), points).otherwise(out)
    return F.when(variance.isNull() | F.isnan(variance), UNKNOWN_POINTS).otherwise(out)


def benchmark_or_stored(market: Column, median: Column, variance: Column, label: Column, note: Column) -> Column:
    """Struct of basis, points, median, variance, label, note and manual: the market's (``market``: points, median, variance, label; null where it has none),
    else the one stored against stock that is held, which says so; a stored median of 0 is none."""
    full = lambda basis, *values: F.struct(*[c.alias(n) for n, c in zip(("basis", "points", "median", "variance", "label", "note", "manual"), (F.lit(basis), *values))])
    nothing, said = F.lit(None), lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    own = full("internal", internal_points(variance), median, variance, said(label, "Compared with comparable stock"), said(note, "Compared against other stock we hold, not the market."), F.lit(True))
    theirs = full("market", market["points"], market["median"], market["variance"], market["label"], nothing.cast("string"), F.lit(False))
    none = full("none", F.lit(UNKNOWN_POINTS), nothing.cast("double"), nothing.cast("double"), nothing.cast("string"), nothing.cast("string"), F.lit(True))
    return F.when(market.isNotNull(), theirs).when(F.coalesce(median, F.lit(0.0)) != 0, own).otherwise(none)


def best_of_each(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each record, with rank (a top-k report). The limit on the rank is kept before the shuffle too, so a record with very many
    candidates sends k rows a task."""
    w = Window.partitionBy("record_id").orderBy(F.col("score").desc(), "id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("record_id").agg(F.count("*").alias(name))


def payloads(briefs: DataFrame, candidates: DataFrame, rejected: DataFrame, k: int, completed: str) -> DataFrame:
    """record_id, payload (JSON) of every brief (record_id, client_name, budget_max). candidates: record_id, id, lot_address, suburb, price, score,
    recommendation, of which the k best are the shortlist. rejected: record_id, a row each."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("lot_address", F.lit("")), F.lit(", "), F.coalesce("suburb", F.lit("")), F.lit(" - "), F.coalesce(money(F.col("price")), F.lit("?")), F.lit(" (Score: "), F.col("score").cast("string"), F.lit("/100 - "), F.coalesce("recommendation", F.lit("")), F.lit(")"))
    one = F.struct("rank", line.alias("line"), "lot_address", "price", "score")
    top = best_of_each(candidates, k).groupBy("record_id").agg(F.array_sort(F.collect_list(one)).alias("top"))  # k at most
    j = briefs.select("record_id", "client_name", "budget_max").join(top, "record_id", "left").join(_counts(rejected, "n_rejected"), "record_id", "left").fillna(0, ["n_rejected"])
    first, n = F.get("top", F.lit(0)), F.greatest(F.size(F.coalesce("top", F.array().cast(top.schema["top"].dataType))), F.lit(0))
    record, client = F.col("record_id").cast("string"), F.col("client_name")
    lines = F.when(n > 0, F.array_join(F.transform("top", lambda x: x["line"]), "\n")).otherwise("None")
    note = F.concat(
        F.lit("Property research completed\nRecord: "), record, F.lit("\nClient: "), client, F.lit(" | Budget ceiling: "), money(F.col("budget_max")), F.lit("\n\nShortlist:\n"), lines,
        F.lit("\n\nRejected: "), F.col("n_rejected").cast("string"), F.lit(f" filtered out.\nStatus: {STATUS}"),
    )
    fields = F.struct(
        F.lit(completed).alias("research_completed_date"), F.when(n > 0, first["lot_address"]).otherwise(NOBODY).alias("top_property_match"), F.coalesce(first["price"].cast("double"), F.lit(0.0)).alias("top_property_price"),
        F.coalesce(first["score"].cast("double"), F.lit(0.0)).alias("top_property_score"), (n + F.col("n_rejected")).alias("candidates_reviewed"),
    )
    task = F.struct(F.lit("Consultant Review & Approval").alias("task_type"), F.concat(F.lit("Review Property Research for "), client).alias("title"), F.lit(24).alias("due_date_hours"), F.lit("Pending Review").alias("status"))
    whole = F.struct(record.alias("research_record_id"), F.lit(STATUS).alias("lead_status"), fields.alias("custom_fields_update"), note.alias("internal_note"), task.alias("consultant_review_task"))
    return j.select("record_id", F.to_json(whole).alias("payload"))


def run_records(briefs: DataFrame, candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """A row per brief: whose it is, where it looks first, its ceiling, and how many candidates it kept and rejected."""
    j = briefs.join(_counts(candidates, "shortlist_count"), "record_id", "left").join(_counts(rejected, "rejected_count"), "record_id", "left")
    return j.select("record_id", F.left("client_name", F.lit(200)).alias("client_name"), "state", F.get("primary_suburbs", F.lit(0)).alias("suburb"), "budget_max", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shortlist_count", "rejected_count")])


AUDIT_TABLES = ("records", "candidates", "rejections")


def save_run(path: str, run: str, records: DataFrame, candidates: DataFrame, rejections: DataFrame) -> None:
    """Appends a run's three tables below ``path``, each in the run's own folder, and its mark last. A run that is saved again replaces itself, and one that broke
    off has no mark, so nobody reads it."""
    for name, df in zip(AUDIT_TABLES, (records, candidates, rejections)):
        df.write.mode("overwrite").parquet(f"{path}/{name}/run={run}")
    records.sparkSession.range(1).select(F.lit(run).alias("id")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/run={run}")


def saved(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of ``AUDIT_TABLES`` over all whole runs; of a record that several runs hold, the last run's rows (runs sort by name)."""
    marks = spark.read.parquet(f"{path}/marks").select("run")
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}").join(marks, "run", "left_semi")
    last = spark.read.option("mergeSchema", "true").parquet(f"{path}/records").join(marks, "run", "left_semi").groupBy("record_id").agg(F.max("run").alias("run"))
    return rows.join(last, ["record_id", "run"], "left_semi")


def links_in_band(rows: DataFrame, links: DataFrame, page: list[str], row: str, pad: float = 2.0, step: float = 8.0) -> DataFrame:
    """rows (page, row, top, bottom; one of each) with ``links``: the uris (links: page, x, y, uri) whose centre lies on the row, give or take ``pad``, from left to
    right. An equi-join on the page and bands of ``step``, of which a link is in one and a row in those between the page's outermost links. Heights that are no
    numbers have no links; equal links stay as often as they are there."""
    centre = links.select(*page, F.col("x").try_cast("double").alias("_x"), number(F.col("y")).alias("_y"), "uri").where("_y IS NOT NULL")
    reach = centre.groupBy(*page).agg(F.min("_y").alias("_least"), F.max("_y").alias("_most"))
    placed = rows.select(*page, row, (number(F.col("top")) - pad).alias("_low"), (number(F.col("bottom")) + pad).alias("_high")).join(reach, page)
    low, high = F.greatest("_low", "_least"), F.least("_high", "_most")
    band = lambda c: F.floor(c / step)
    cut = placed.where(F.col("_low").isNotNull() & F.col("_high").isNotNull() & (low <= high)).withColumn("_band", F.explode(F.sequence(band(low), band(high))))
    hit = cut.join(centre.withColumn("_band", band(F.col("_y"))), [*page, "_band"]).where(F.col("_y").between(F.col("_low"), F.col("_high")))
    found = hit.groupBy(*page, row).agg(F.transform(F.array_sort(F.collect_list(F.struct("_x", "uri"))), lambda x: x["uri"]).alias("links"))
    return rows.join(found, [*page, row], "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
