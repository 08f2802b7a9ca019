"""Alarms of a stream against those of the batch operator, and these against a plain count."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrace.operators import channels
from terrace.streaming import alarms

#: Captures a day: steady, dying on the fourth day, collapsing, small, coming back.
COUNTS = {"steady": [30] * 8, "dies": [40, 40, 40], "collapses": [40, 40, 15, 40, 9, 0, 25, 40], "small": [3, 1, 2, 0, 1], "late": [0, 0, 50, 5, 50]}
START = datetime(2026, 3, 1)


def captures():
    return [(c, START + timedelta(days=d, minutes=7 * i)) for c, counts in COUNTS.items() for d, n in enumerate(counts) for i in range(n)]


def plain(last):
    out = set()
    for c, counts in COUNTS.items():
        first = next(i for i, n in enumerate(counts) if n)
        for d in range(first, last + 1):
            read = counts[d] if d < len(counts) else 0
            stored, previous = sum(counts[first:d]), counts[d - 1] if first < d <= len(counts) else 0
            floor, alarm = alarms.judge(read, previous, stored)
            if alarm:
                out.add((c, (START + timedelta(days=d)).date(), read, floor, alarm))
    return out


def test_batch(spark):
    df = spark.createDataFrame(captures(), "channel string, ts timestamp")
    got = {tuple(r) for r in channels.daily_alarms(df, "channel", F.to_date("ts"), F.lit(date(2026, 3, 8))).collect()}
    assert got == plain(7) and {a for *_, a in got} == {"dead", "collapsed"}


def test_stream_equals_batch(spark, tmp_path):
    """Days come two to a file, the earlier day's captures partly in the later file; a last capture moves the clock on."""
    pytest.importorskip("google.protobuf")
    alarms.prepare(spark)
    rows = captures()
    for n in range(5):
        part = [(c, t) for i, (c, t) in enumerate(rows) if min(4, (t - START).days // 2 + (i % 5 == 0 and (t - START).days % 2)) == n]
        spark.createDataFrame(part, "channel string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for day in (12, 13):
        spark.createDataFrame([("clock", START + timedelta(days=day))], "channel string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = alarms.watch(stream, "channel", "ts", "2 days")
    found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("channel <> 'clock'").collect()}
    assert {r for r in got if r[1] <= date(2026, 3, 8)} == plain(7)
    assert all(r[1] <= date(2026, 3, 12) for r in got)
