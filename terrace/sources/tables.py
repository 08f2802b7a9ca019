"""Table scans and sinks: snapshots, upserts and exports as immutable Parquet versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import captures, guards

#: Types that an added column may have.
ADDED_TYPES = {"string", "double", "int", "bigint"}


def scan(spark: SparkSession, path: str, equals: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table, its columns and rows pruned at the scan."""
    out = spark.read.option("mergeSchema", "true").parquet(path)
    for c, v in (equals or {}).items():
        out = out.where(F.col(c) == v)
    return out.select(*columns) if columns else out


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that Spark can read; an error names all that were tried."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(conf).exists(where):
            return p
    raise FileNotFoundError(f"none of {paths}")


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive evolution: absent columns are appended as nulls of an allowed type."""
    for c, t in columns.items():
        if t not in ADDED_TYPES:
            raise ValueError(f"type {t} of {c}")
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


def upsert(spark: SparkSession, old_path: str | None, new: DataFrame, key: str, rules: dict[str, str], previous: dict[str, str], out_path: str) -> DataFrame:
    """Merges new captures into a table and writes the next version; returns the counts by outcome. Equal keys in new must be reduced first."""
    columns = [key, *rules, *previous.values()]
    old = spark.read.parquet(old_path).select(*columns) if old_path else new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in columns]).limit(0)
    fresh = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns])
    captures.merge(old, fresh, key, rules, previous).write.mode("errorifexists").parquet(out_path)
    return spark.read.parquet(out_path).groupBy("outcome").count()


def export_csv(df: DataFrame, columns: dict[str, str], order: list[Column], path: str) -> None:
    """An ordered CSV with a header, also when there are no rows. One file is what people open, and this export is for people."""
    guards.export_rows(df, columns, order).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def publish(df: DataFrame, allowed: set[str], path: str, last: int | None) -> int:
    """Writes the public columns once every guard has found nothing; returns the rows."""
    public = df.select(*guards.whitelist(df.columns, allowed))
    guards.require_none(guards.contact_violations(public), "contact details")
    if urls := [c for c in public.columns if c.endswith("_url")]:
        guards.require_none(guards.violations(public, {c: F.col(c).rlike(guards.FOLDER_LINK) for c in urls}), "folder links")
    n = public.count()
    guards.publish_floor(n, last)
    public.write.mode("overwrite").parquet(path)
    return n
