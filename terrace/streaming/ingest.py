"""Streams: captures merged as they arrive, and event windows (the latter go beyond what a nightly batch needs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import captures


def read_captures(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


#: Parts of a table by hash of the key; a batch rewrites those it touches.
BUCKETS = 64


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict[int, int]:
    """Which version of each bucket makes up the table at a version (by default the last). A manifest is written after all that it names, so a batch
    that broke off is not seen."""
    if version is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/manifest")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [p.getPath() for p in fs.listStatus(where)] if fs.exists(where) else []
        version = max((int(p.getName().split("=")[1]) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=-1)
    return {r.bucket: r.version for r in spark.read.parquet(f"{table}/manifest/v={version}").collect()} if version >= 0 else {}  # BUCKETS rows at most


def _state(spark: SparkSession, table: str, buckets: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{table}/v={v}/bucket={b}" for b, v in sorted(buckets.items())]) if buckets else None


def current(spark: SparkSession, table: str, key: str, rules: dict[str, str], previous: dict[str, str]) -> DataFrame:
    """The table as its last complete batch left it."""
    return captures.settled_values(_state(spark, table, manifest(spark, table)), key, rules, previous)


def merge_batch(batch: DataFrame, number: int, table: str, key: str, rules: dict[str, str], previous: dict[str, str], time: list[str], buckets: int = BUCKETS) -> None:
    """Merges one batch: the buckets that it touches are read at the version before, settled with its captures and written as ``table/v=number``; the
    manifest names them beside the versions of all others. A batch that is run again reads the same versions and writes the same rows. Files that neither this nor the
    last manifest names are deleted."""
    spark = batch.sparkSession
    fresh = captures.registers(batch, key, rules, previous, time).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # numbers below ``buckets``
    old = manifest(spark, table, number - 1)
    known = _state(spark, table, {b: old[b] for b in touched if b in old})
    rows = fresh.drop("bucket") if known is None else known.unionByName(fresh.drop("bucket"))
    out = captures.settle(rows, key, rules, previous).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    out.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={number}")
    now = old | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v={number}")
    if number > 1:
        for b, v in manifest(spark, table, number - 2).items():
            if v not in (old.get(b), now[b]):
                _delete(spark, f"{table}/v={v}/bucket={b}")


def upsert_stream(stream: DataFrame, table: str, key: str, rules: dict[str, str], previous: dict[str, str], newest: list[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merges the stream's captures into a table by key. Each column keeps a register of its own (value and time of the capture that it is from), so the
    table doesn't depend on the order in which captures arrive or on where batches end, and a batch rewrites only the buckets of its keys. ``newest`` orders captures."""

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty() or number == 0:
            merge_batch(batch, number, table, key, rules, previous, newest, buckets)
        else:  # nothing came: the version before goes on under this number
            spark = batch.sparkSession
            spark.createDataFrame(sorted(manifest(spark, table, number - 1).items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str = "1 hour", session: bool = False) -> DataFrame:
    """Counts by tumbling, sliding or session window; rows later than the watermark are dropped by a stream."""
    w: Column = F.session_window(time, length) if session else F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
