"""Publishing: exports in a fixed order and shape, and guards that have to find nothing before a write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]{2,}"
PHONE = r"(?<![\d-])(?:\+?61[ -]?)?(?:\(0[2-478]\)[ -]?|0[2-478][ -]?)\d{4}[ -]?\d{4}(?![\d-])|(?<![\d-])04\d{2}[ -]?\d{3}[ -]?\d{3}(?![\d-])"
FOLDER_LINK = r"(?i)drive\.google\.com/(?:drive/)?(?:u/\d+/)?folders/|dropbox\.com/(?:sh|scl/fo)/|onedrive\.live\.com/.*folder|sharepoint\.com/.*:f:"
NOT_FREE_TEXT = frozenset(("content_hash", "sha256", "dedup_key", "row_key", "superseded_by"))
MIN_ROWS, MIN_SHARE = 500, 0.8
HASHED = frozenset(("source_channel", "attribution_scope", "builder_name", "suburb", "lot_number", "house_design", "land_sqm", "variant_key"))


def has_contact(c: Column) -> Column:
    return c.rlike(EMAIL) | c.rlike(PHONE)


def redact(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, EMAIL, "[email withheld]"), PHONE, "[phone withheld]")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def contact_violations(df: DataFrame) -> DataFrame:
    """column, n: texts with an address or a phone number, digests and urls aside. One pass over all columns."""
    free = [c for c, t in df.dtypes if t == "string" and c not in NOT_FREE_TEXT and not c.endswith("_url")]
    bad = df.agg(*[F.count_if(~F.col(c).startswith("http") & has_contact(F.col(c))).alias(c) for c in free])
    return bad.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in free])).alias("x")).select("x.*").where("n > 0")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n for every rule that a row breaks."""
    got = df.agg(*[F.count_if(v).alias(k) for k, v in rules.items()])
    return got.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("x")).select("x.*").where("n > 0")


def require_none(found: DataFrame, what: str) -> None:
    if not found.isEmpty():
        raise ValueError(f"not published: {what}: {found.limit(8).collect()}")


def publish_floor(n: int, last: int | None) -> None:
    """Refuses a set that is too small, or much smaller than the last one."""
    if n < MIN_ROWS or (last and n < MIN_SHARE * last):
        raise ValueError(f"not published: {n} rows; the last time {last}, at least {MIN_ROWS}")


def check_write(columns: list[str]) -> None:
    """Columns that identities are made of are never rewritten."""
    if hit := HASHED & set(columns):
        raise ValueError(f"identity columns in a write: {sorted(hit)}")


def export_rows(df: DataFrame, columns: dict[str, str], order: list[Column]) -> DataFrame:
    """Labelled columns as text, white space flattened, nulls empty, in a total order."""
    flat = lambda c: F.coalesce(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")), F.lit(""))
    return df.orderBy(*order).select(*[flat(c).alias(label) for c, label in columns.items()])


def mark(df: DataFrame, marks: DataFrame, key: str, column: str) -> DataFrame:
    """df with ``column`` set to 1 where the key is in marks (K-12)."""
    m = marks.select(key).distinct().withColumn("_m", F.lit(1))
    return df.join(m, key, "left").withColumn(column, F.coalesce("_m", F.col(column) if column in df.columns else F.lit(0))).drop("_m")


def whitelist(columns: list[str], allowed: set[str], secret: str = r"(?i)passw|secret|token|login|contact|phone|e?mail") -> list[str]:
    """The columns that may be published; one that looks like a secret is an error even if it is on the list."""
    import re

    bad = [c for c in columns if c in allowed and re.search(secret, c)]
    if bad:
        raise ValueError(f"secrets on the list of public columns: {bad}")
    return [c for c in columns if c in allowed]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
