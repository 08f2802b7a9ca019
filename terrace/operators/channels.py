"""Channel health: counts, the latest day that was read, and alarms when a channel dies or collapses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIOUS_SHARE, STORED_SHARE, BASELINE = 0.5, 0.25, 20


def counts(df: DataFrame, channel: str, live: Column) -> DataFrame:
    return df.groupBy(channel).agg(F.count("*").alias("total"), F.count_if(live).alias("live"))


def latest_day(df: DataFrame, channel: str, day: Column) -> DataFrame:
    """Rows of each channel's last day."""
    per = df.groupBy(channel, day.alias("day")).agg(F.count("*").alias("n"))
    return per.groupBy(channel).agg(F.max("day").alias("day"), F.max_by("n", "day").alias("n"))


def alarms(read: DataFrame, stored: DataFrame, previous: DataFrame, channel: str) -> DataFrame:
    """Channels that read nothing although they hold rows (dead), or far less than before or than they hold (collapsed). Each side: channel, n."""
    j = read.withColumnRenamed("n", "r").join(stored.withColumnRenamed("n", "s"), channel, "full_outer").join(previous.withColumnRenamed("n", "p"), channel, "full_outer")
    r, s, p = (F.coalesce(c, F.lit(0)) for c in ("r", "s", "p"))
    floor = F.greatest(F.when(p >= BASELINE, F.floor(p * PREVIOUS_SHARE)).otherwise(0), F.when(s >= BASELINE, F.floor(s * STORED_SHARE)).otherwise(0))
    alarm = F.when((r == 0) & (s > 0), "dead").when((r > 0) & (r < floor), "collapsed")
    return j.select(channel, r.alias("read"), floor.alias("floor"), alarm.alias("alarm")).where("alarm IS NOT NULL")


def floor_of(previous: Column, stored: Column) -> Column:
    """The least that a channel should read: half of the day before, a quarter of what it holds, where these are large enough to tell."""
    return F.greatest(F.when(previous >= BASELINE, F.floor(previous * PREVIOUS_SHARE)).otherwise(0), F.when(stored >= BASELINE, F.floor(stored * STORED_SHARE)).otherwise(0))


def daily_alarms(df: DataFrame, channel: str, day: Column, until: Column) -> DataFrame:
    """channel, day, read, floor, alarm for every day from a channel's first up to ``until`` on which it was silent or collapsed against the day before and
    against all that it had read by then. Counts per day are what is windowed, not rows."""
    n = df.groupBy(channel, day.cast("date").alias("day")).agg(F.count("*").alias("n"))
    days = n.groupBy(channel).agg(F.min("day").alias("first")).where(F.col("first") <= until).select(channel, F.explode(F.sequence("first", until)).alias("day"))
    w = Window.partitionBy(channel).orderBy("day")
    j = days.join(n, [channel, "day"], "left").withColumn("read", F.coalesce("n", F.lit(0)))
    j = j.withColumns({"previous": F.coalesce(F.lag("read").over(w), F.lit(0)), "stored": F.coalesce(F.sum("read").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    floor = floor_of(F.col("previous"), F.col("stored"))
    alarm = F.when((F.col("read") == 0) & (F.col("stored") > 0), "dead").when((F.col("read") > 0) & (F.col("read") < floor), "collapsed")
    return j.select(channel, "day", "read", floor.alias("floor"), alarm.alias("alarm")).where("alarm IS NOT NULL")
