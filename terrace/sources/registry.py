"""The public registry of companies: an export without anybody's contact details that is read back before anyone may see it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the columns that readers of the registry know by place; contacts, logins and passwords are always blank ---
COLUMNS = ("NAME", "EMAIL", "PHONE", "BUILDER", "STATES", "Contract Availble??", "Is it available on E Agent?", "WEB PORTAL LINK", "EMAIL", "PASSWORD", "NOTES")
BLANK = (0, 1, 2, 8, 9)
CONTACT = r"(?i)[\w.+-]+@[\w-]+\.[\w.]{2,}|0[2-478](?:[ \-]?\d){8}|(?:\+?61[ \-]?)[2-478](?:[ \-]?\d){8}"
REMOVED = "[contact detail removed]"
# --- ---
_NAMES = [f"c{i}" for i in range(len(COLUMNS))]


def without_contacts(c: Column) -> Column:
    """Free text with every address and phone number taken out, and a note where it was."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), CONTACT, F.lit(REMOVED))


def public_rows(companies: DataFrame) -> DataFrame:
    """c0 to c10 as the registry has them. companies: builder_name, states (array), contract_available, agent_available, portal_url, notes."""
    text = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    name = F.trim(F.coalesce("builder_name", F.lit("")))
    said = {3: name, 4: F.coalesce(F.array_join("states", "/"), F.lit("")), 5: text(F.col("contract_available")), 6: text(F.col("agent_available")), 7: text(F.col("portal_url")), 10: text(without_contacts(F.col("notes")))}
    return companies.where(name != "").select(*[F.trim(said.get(i, F.lit(""))).alias(c) for i, c in enumerate(_NAMES)])


def fingerprint() -> list[Column]:
    """Sums that tell a set of rows whatever their order: their number, and two sums of their hashes (one alone would miss rows that are there twice)."""
    h = F.xxhash64(*_NAMES)
    return [F.count("*").alias("rows"), F.bit_xor(h).alias("mixed"), F.sum(F.shiftrightunsigned(h, 20)).alias("sum")]


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in _NAMES)
    return spark.read.schema(schema).options(header=True, enforceSchema=True, mode="FAILFAST", quote='"', escape='"', nullValue="\u0000", emptyValue="").csv(path).fillna("")


def check_registry(spark: SparkSession, path: str, written: dict | None) -> int:
    """Reads an export and raises unless it is what was written and every column that has to be blank is. Returns its rows."""
    kept = read_registry(spark, path)
    seen = kept.agg(*fingerprint(), *[F.count_if(F.trim(_NAMES[i]) != "").alias(f"full{i}") for i in BLANK], F.count_if(F.col("c10").rlike(CONTACT)).alias("contacts")).first().asDict()
    if full := [COLUMNS[i] for i in BLANK if seen[f"full{i}"]]:
        raise ValueError(f"not published: columns that have to be blank are not: {full}")
    if seen["contacts"]:
        raise ValueError(f"not published: {seen['contacts']} notes with contact details")
    if written is not None and any(seen[k] != written[k] for k in ("rows", "mixed", "sum")):
        raise ValueError(f"not published: {seen['rows']} rows read back, {written['rows']} written, or not the same")
    return seen["rows"]


def write_registry(companies: DataFrame, path: str) -> int:
    """Writes the registry beside ``path``, taking its fingerprint on the way (no second pass over the source), reads the files back, and only then moves
    them to path. If anything differs, nothing is at path that wasn't before, and an error says what."""
    spark = companies.sparkSession
    rows, side = public_rows(companies), f"{path.rstrip('/')}.unchecked-{uuid.uuid4().hex[:8]}"
    written = Observation()
    labels = [f"{c}#{i}" if COLUMNS.count(c) > 1 else c for i, c in enumerate(COLUMNS)]  # a header may not say EMAIL twice; readers go by place
    rows.observe(written, *fingerprint()).toDF(*labels).write.options(header=True, quote='"', escape='"', emptyValue="").csv(side)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(side).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        n = check_registry(spark, side, written.get)
    except Exception:
        fs.delete(hadoop(side), True)
        raise
    fs.delete(hadoop(path), True)
    if not fs.rename(hadoop(side), hadoop(path)):
        raise OSError(f"{side} could not be moved to {path}")
    return n
