"""Channel alarms while captures stream in: counts per channel and day as keyed state, and a timer that goes off when a day ends whether or not the channel was read."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.channels import BASELINE, PREVIOUS_SHARE, STORED_SHARE

ALARM = "channel string, day date, read long, floor long, alarm string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = date(1970, 1, 1)


def _number(ms: int) -> int:
    return ms // 86_400_000


def judge(read: int, previous: int, stored: int) -> tuple[int, str | None]:
    """(floor, alarm) of a day, as ``channels.daily_alarms`` has them."""
    floor = max(math.floor(previous * PREVIOUS_SHARE) if previous >= BASELINE else 0, math.floor(stored * STORED_SHARE) if stored >= BASELINE else 0)
    return floor, "dead" if read == 0 and stored > 0 else "collapsed" if 0 < read < floor else None


class _Watch(StatefulProcessor):
    """State of a channel: counts of its open days, and (next day to close, the day before's count, all counted before). A day closes when the watermark passes its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day int", "n long")
        self.closed = handle.getValueState("closed", "next int, previous long, stored long")

    def _arm(self, day: int) -> None:
        self.handle.registerTimer((day + 1) * 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            for day, n in batch["day"].value_counts().items():
                had = self.open.getValue((int(day),))[0] if self.open.containsKey((int(day),)) else 0
                self.open.updateValue((int(day),), (had + int(n),))
                first = int(day) if first is None else min(first, int(day))
        if first is not None:
            known = self.closed.get()
            if known is None or (known[1] == 0 and known[2] == 0 and first < known[0]):
                self.closed.update((first, 0, 0))
                self._arm(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, previous, stored = self.closed.get()
        ended, out = _number(timerValues.getCurrentWatermarkInMs()), []
        while day < ended:
            read = self.open.getValue((day,))[0] if self.open.containsKey((day,)) else 0
            if read:
                self.open.removeKey((day,))
            floor, alarm = judge(read, previous, stored)
            if alarm:
                out.append((key[0], EPOCH + timedelta(days=day), read, floor, alarm))
            day, previous, stored = day + 1, read, stored + read
        self.closed.update((day, previous, stored))
        self._arm(day)
        yield pd.DataFrame(out, columns=["channel", "day", "read", "floor", "alarm"])


def watch(captures: DataFrame, channel: str, time: str, late: str = "1 day") -> DataFrame:
    """A stream of ALARM rows from a stream of captures: channels that were silent, or collapsed, on a day that has ended. A day is closed once the stream has
    gone ``late`` beyond its end; what comes for it afterwards is not counted. Needs the RocksDB state store (``prepare``)."""
    rows = captures.select(F.col(channel).alias("channel"), F.col(time).alias("_time"), F.unix_date(F.to_date(time)).alias("day")).withWatermark("_time", late)
    return rows.groupBy("channel").transformWithStateInPandas(_Watch(), ALARM, "Append", "EventTime")


def prepare(spark: SparkSession) -> None:
    """Timers and keyed state need a state store that can hold them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
