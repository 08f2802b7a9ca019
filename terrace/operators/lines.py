"""Operators on source lines: recovery rules kept as data, the structure of prices on a line, and the verdict on a stored price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amounts

RANGES = {"house_sqm": (40, 900), "land_sqm": (60, 40000), "bedrooms": (1, 10), "bathrooms": (1, 8), "car_spaces": (0, 8), "frontage_m": (3, 80), "postcode": (800, 9999), "lot_number": (1, 999999)}
TOLERANCE = 2_000.0
COMPONENT_PRODUCT = r"(?i)\bland\s*only\b|\bbuild\s*only\b|\bhouse\s*only\b|\bvacant\s+land\b|\bregistered\s+land\b|\bland\s+package\b(?!\s*\+)"
MAX_RULES = 10_000


def recover(rows: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """rows with blank fields filled by their cohort's rules. rules: cohort, field, pattern (one group), ord; of several the last valid one wins.
    The rules are a short list; a pattern meets only rows of its cohort."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError("too many rules to broadcast")
    j = rows.select("id", "cohort", "source_text", *[F.col(f).cast("string").alias(f) for f in fields]).join(F.broadcast(rules), "cohort")
    value = F.expr("nullif(regexp_extract(source_text, concat('(?i)', pattern), 1), '')")
    held, ok = F.lit(None).cast("string"), F.lit(True)
    for f in fields:
        held = F.when(F.col("field") == f, F.nullif(F.nullif(F.col(f), F.lit("")), F.lit("0"))).otherwise(held)
        low, high = RANGES.get(f, (None, None))
        ok = F.when(F.col("field") == f, F.lit(True) if low is None else F.coalesce(F.regexp_replace("v", ",", "").try_cast("double").between(low, high), F.lit(False))).otherwise(ok)
    found = j.withColumn("v", value).withColumn("held", held).where("v IS NOT NULL AND held IS NULL").where(ok)
    got = found.groupBy("id").agg(*[F.max(F.when(F.col("field") == f, F.struct("ord", "v"))).alias(f"_{f}") for f in fields])
    return rows.join(got, "id", "left").select(*[F.coalesce(F.nullif(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0")), F.regexp_replace(F.col(f"_{c}.v"), ",", "")).alias(c) if c in fields else F.col(c) for c in rows.columns])


def price_structure(lines: DataFrame, key: str, text: str) -> DataFrame:
    """key, role (total or component), amount, total: pairs on a line that add up to a third amount of it. Lines are short: pairs are built
    inside the row."""
    a = amounts(F.col(text))
    at = F.sequence(F.lit(0), F.size("_a") - 1)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    trio = F.flatten(F.transform(pairs, lambda p: F.transform(F.filter(at, lambda k: (k != p.i) & (k != p.j)), lambda k: F.struct(F.get("_a", p.i).alias("x"), F.get("_a", p.j).alias("y"), F.get("_a", k).alias("t")))))
    good = F.filter(trio, lambda z: (F.abs(z.x + z.y - z.t) <= TOLERANCE) & (z.t > F.greatest(z.x, z.y)))
    e = lines.select(key, a.alias("_a")).where(F.size("_a") >= 3).select(key, F.explode(good).alias("z"))
    roles = F.array(F.struct(F.lit("total").alias("role"), F.col("z.t").alias("amount"), F.col("z.t").alias("total")), *[F.struct(F.lit("component").alias("role"), F.col(f"z.{c}").alias("amount"), F.col("z.t").alias("total")) for c in ("x", "y")])
    return e.select(key, F.explode(roles).alias("r")).select(key, "r.*").distinct()


def verify_price(rows: DataFrame, structure: DataFrame, key: str) -> DataFrame:
    """id, verdict, fix: what a row's own file says of its price. A total within the tolerance; a component exactly, with the least total
    that holds it as the fix."""
    s = structure.groupBy(key).agg(F.count("*").alias("n"))
    band = lambda c, width: F.floor(F.col(c) / width)
    # a file's totals by bands of the tolerance's width, its components by bands of one: a price meets its own band and the two beside it
    total = structure.where("role = 'total'").groupBy(key, band("amount", TOLERANCE).alias("_b")).agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    part = structure.where("role = 'component'").groupBy(key, "amount").agg(F.min("total").alias("total")).withColumn("_b", band("amount", 1.0))
    beside = lambda width: rows.select("id", key, "price", F.explode(F.array(*[band("price", width) + i for i in (-1, 0, 1)])).alias("_b"))
    off = lambda c: F.abs(F.col("price") - F.col(c))
    totals = beside(TOLERANCE).join(total, [key, "_b"]).where((off("lo") <= TOLERANCE) | (off("hi") <= TOLERANCE)).select("id").distinct().withColumn("is_total", F.lit(1))
    fixes = beside(1.0).join(part, [key, "_b"]).where(off("amount") < 1).groupBy("id").agg(F.min("total").alias("fix"))
    g = rows.join(s, key, "left").groupBy("id").agg(F.first("text").alias("text"), F.first("n").alias("n")).join(totals, "id", "left").join(fixes, "id", "left")
    verdict = F.when(F.col("text").rlike(COMPONENT_PRODUCT), "PART SOLD ALONE").when(F.col("n").isNull(), "NO EVIDENCE").when(F.col("is_total") == 1, "TOTAL").when(F.col("fix").isNotNull(), "COMPONENT").otherwise("NOT FOUND")
    return g.select("id", verdict.alias("verdict"), F.when(verdict == "COMPONENT", F.col("fix")).alias("fix"))


def coalesce_fields(df: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with blank fields (null or empty) taken from other: enrichment that never overwrites. Of a key's rows in other the first by ``ord`` that has the field
    gives it; blanks there are nobody's answer."""
    blank = lambda c: c.isNull() | (c.cast("string") == "")
    best = other.groupBy(key).agg(*[F.min(F.when(~blank(F.col(c)), F.struct("ord", F.col(c).alias("v"))))["v"].alias(f"_{c}") for c in fields])
    return df.join(best, key, "left").select(*[F.when(blank(F.col(c)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def subsumed(loser: str, keeper: str, fields: list[str]) -> Column:
    """Whether every field of the loser is null or the keeper's."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.col(f"{loser}.{f}").isNull() | F.col(f"{loser}.{f}").eqNullSafe(F.col(f"{keeper}.{f}")))
    return out
