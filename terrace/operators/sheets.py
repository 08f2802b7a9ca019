"""Sheets read by their own header rows: which columns are money, which state a fact, and what a row says once that is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean

#: A bare number below this is no price, whatever its column.
LEAST_MONEY = 1000
# --- fixed values: headers of money and what rules it out; headers of facts with the field, its least and its largest value ---
MONEY = r"(?i)price|cost|\$|total|amount|value|deposit|rrp|package|pkg"
NOT_MONEY = (
    r"(?i)size|area|sqm|m2|m²|width|depth|frontage|bed|bath|car|garage|storey|living|no\.|number|lot|date|title|status|design|facade|link|brochure|yield|%|"
    r"floor|internal|external|aspect|orientation|stage|type|name|comment|note"
)
FACTS = (
    ("bedrooms", r"(?i)\bbed(?:room)?s?\b", 1, 12),
    ("bathrooms", r"(?i)\bbath(?:room)?s?\b", 1, 12),
    ("car_spaces", r"(?i)\b(?:car(?:\s*space)?s?|garage|gge)\b", 0, 12),
    ("land_size_sqm", r"(?i)\b(?:land|lot)\s*(?:size|area)\b", 30, 100_000),
    ("house_size_sqm", r"(?i)\b(?:house|home|build(?:ing)?|floor|living|internal)\s*(?:size|area)\b", 20, 3_000),
    ("frontage_m", r"(?i)\bfrontage\b", 1, 200),
)
NO_FACT = r"(?i)price|cost|\$|deposit|total|rent"
WHOLE_NUMBERS = ("bedrooms", "car_spaces")
# --- ---


def typed(labels: Column) -> Column:
    """An array of (at, label) in order, with ``money`` and ``field``: a column states the first fact that its label names and no column before it has."""
    field = lambda taken, label: F.when(~label.rlike(NO_FACT), F.coalesce(*[F.when(label.rlike(p) & ~F.array_contains(taken, name), F.lit(name)) for name, p, _, _ in FACTS]))

    def step(done: Column, x: Column) -> Column:
        f = field(done.taken, x.label)
        one = F.struct(x.at.alias("at"), (x.label.rlike(MONEY) & ~x.label.rlike(NOT_MONEY)).alias("money"), f.alias("field"))
        return F.struct(F.array_append(done.taken, F.coalesce(f, F.lit(""))).alias("taken"), F.array_append(done.out, one).alias("out"))

    none = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<at:int,money:boolean,field:string>>").alias("out"))
    return F.aggregate(labels, none, step, lambda done: done.out)


def read_rows(rows: DataFrame, part: list[str], order: str, is_header: Column) -> DataFrame:
    """part, order, line and a column per fact, for each data row. rows: part, order, cells (array of texts), currency (array of booleans: cells that the sheet itself
    formats as money; may be null). Header rows that follow each other add up per column; a later block replaces them. In a money column, or a currency cell, a bare
    number of LEAST_MONEY or more gets its dollar sign; a fact out of its bounds is no fact."""
    w = Window.partitionBy(*part).orderBy(order)
    head = F.coalesce(is_header, F.lit(False))
    starts = (head & ~F.coalesce(F.lag(head).over(w), F.lit(False))).cast("int")
    r = rows.withColumn("_head", head).withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = r.where("_head").select(*part, order, "_run", F.posexplode("cells").alias("at", "value")).where("value <> ''")
    label = names.groupBy(*part, "_run", "at").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: x["value"]), " ")).alias("label"))
    columns = label.groupBy(*part, "_run").agg(typed(F.array_sort(F.collect_list(F.struct("at", "label")))).alias("columns"))  # as many as a sheet has columns
    j = r.where("NOT _head").join(columns, [*part, "_run"], "left")

    known = F.coalesce(F.col("columns"), F.array().cast("array<struct<at:int,money:boolean,field:string>>"))
    money = F.transform(F.filter(known, lambda c: c.money), lambda c: c.at)
    plain = lambda x: F.regexp_replace(x, ",", "")

    def shown(x: Column, i: Column) -> Column:
        number = F.when(plain(x).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(plain(x)).try_cast("double"))
        priced = ~x.contains("$") & (F.array_contains(money, i) | F.coalesce(F.get("currency", i), F.lit(False))) & (F.abs(number) >= LEAST_MONEY)
        return F.when(F.coalesce(priced, F.lit(False)), F.concat(F.lit("$"), F.format_number(number, 0))).otherwise(x)

    line = clean(F.array_join(F.filter(F.transform("cells", shown), lambda x: x != ""), " "))

    def fact(name: str, low: int, high: int) -> Column:
        at = F.get(F.transform(F.filter(known, lambda c: c.field == name), lambda c: c.at), F.lit(0))
        value = F.regexp_extract(plain(F.trim(F.get("cells", at))), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
        return F.when(value.between(low, high), value).cast("int" if name in WHOLE_NUMBERS else "double").alias(name)

    return j.select(*part, order, line.alias("line"), *[fact(name, low, high) for name, _, low, high in FACTS])


def fill_blanks(listings: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """listings with facts of their row where they have none (null or 0); what the row's own words said stays."""
    names = [name for name, *_ in FACTS if name in listings.columns]
    j = listings.join(facts.select(*keys, *[F.col(n).alias(f"_{n}") for n in names]), keys, "left")
    return j.select(*[F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(f"_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in listings.columns])
