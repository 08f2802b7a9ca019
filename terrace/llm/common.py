"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package

#: What separates words where a contract says ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps neither recompute it nor depend on an executor's disk."""
    path = f"{shared_folder(df.sparkSession)}/terrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.terrace_path = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote for these, once no later step reads it."""
    for df in written:
        if path := getattr(df, "terrace_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The whole text's words, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``: the folds of the contracts; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def columns_of(df: DataFrame, **defaults: str) -> DataFrame:
    """The named columns by type, null where df has none, so that an operator never trips over a missing or extra one."""
    ship_package(df.sparkSession)
    columns = df.columns

    def place(name: str) -> int | None:
        """By exact name first, then whatever the case; of equal names the first."""
        found = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
        return found[0] if found else None

    mine = {c: at for c in defaults if (at := place(c)) is not None}
    df = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return df.select(*[(F.col(f"_{mine[c]}") if c in mine else F.lit(None)).cast(t).alias(c) for c, t in defaults.items()])
