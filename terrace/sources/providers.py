"""Providers of comparables: something that is asked for listings of places and answers with rows, never with an exception.

A provider has ``search(asked)``: asked has suburb, state and kind, each combination once; the answer has ``FOUND`` columns. What a provider could not tell
(a place without an answer after all tries) is a row with ``error``, so that "nothing for sale there" and "nobody was asked" differ.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "suburb string, state string, kind string, comp_id string, bedrooms int, land_sqm double, price double, price_from double, price_to double, is_new boolean, error string"
EXACT, MIDDLE = "exact", "range-mid"


class Provider(Protocol):
    name: str

    def search(self, asked: DataFrame) -> DataFrame: ...


class Nobody:
    """No provider: finds nothing, and says why."""

    name = "none"

    def __init__(self, reason: str = "no provider of comparables is configured"):
        self.reason = reason

    def search(self, asked: DataFrame) -> DataFrame:
        return asked.sparkSession.createDataFrame([], FOUND)


class Stored:
    """Comparables of a table; places are joined to it. kinds: which of the table's own types (``type``) a kind of price stands for."""

    name = "stored"

    def __init__(self, table: DataFrame, kinds: dict[str, list[str]]):
        self.table, self.kinds = table, kinds

    def search(self, asked: DataFrame) -> DataFrame:
        pairs = [(kind, t) for kind, types in self.kinds.items() for t in types]
        kinds = asked.sparkSession.createDataFrame(pairs, "kind string, type string")
        wanted = asked.select("suburb", "state", "kind").join(F.broadcast(kinds), "kind")  # the parameter's few rows
        columns = [c.split(" ")[0] for c in FOUND.split(", ")]
        return wanted.join(self.table, ["suburb", "state", "type"]).withColumn("error", F.lit(None).cast("string")).select(*columns)


class Unanswered(Exception):
    """What a call raises. again: whether asking once more may help (a rate limit, a server at fault); wait: seconds that the service asks for."""

    def __init__(self, message: str, again: bool = False, wait: float | None = None):
        super().__init__(message)
        self.again, self.wait = again, wait


class Called:
    """A service that is called once per place. ``call(suburb, state, kind)`` gives dicts with the columns of FOUND, or raises. Failures that may pass are tried again
    after a growing, jittered wait; in the end they are a row with ``error``. ``calls`` of places are spread over ``tasks`` tasks, since services limit how
    many may ask at once."""

    name = "called"

    def __init__(self, call: Callable[[str, str, str], list[dict]], tries: int = 3, wait: float = 1.0, tasks: int = 4):
        self.call, self.tries, self.wait, self.tasks = call, tries, wait, tasks

    def search(self, asked: DataFrame) -> DataFrame:
        call, tries, wait = self.call, self.tries, self.wait
        columns = [c.split(" ")[0] for c in FOUND.split(", ")]

        def answer(suburb: str, state: str, kind: str) -> list[dict]:
            said = ""
            for attempt in range(tries):
                try:
                    return [{**row, "error": None} for row in call(suburb, state, kind)]
                except Unanswered as e:
                    said = str(e)
                    if not e.again:
                        break
                    pause = e.wait
                except Exception as e:  # whatever a client raises must not fail the search
                    said, pause = f"{type(e).__name__}: {e}", None
                if attempt + 1 < tries:
                    time.sleep(wait * 2**attempt * (1 + random.random() / 4) if pause is None else pause)
            return [{"error": said or "no answer"}]

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for place in batch.itertuples(index=False):
                    found = [{"suburb": place.suburb, "state": place.state, "kind": place.kind} | {k: v for k, v in row.items() if k not in ("suburb", "state", "kind")} for row in answer(place.suburb, place.state, place.kind)]
                    if found:
                        out = pd.DataFrame(found, columns=columns)
                        yield out.astype({"bedrooms": "Int32", "is_new": "boolean", **{c: "float64" for c in ("land_sqm", "price", "price_from", "price_to")}}).astype({"comp_id": "object"})

        return asked.select("suburb", "state", "kind").repartition(self.tasks, "suburb", "state", "kind").mapInPandas(ask, FOUND)


def provider(name: str | None, known: dict[str, Callable[[], Provider | None]]) -> Provider:
    """The provider of a name; Nobody with the reason if there is none of that name or it isn't configured (its maker returns None)."""
    if not name:
        return Nobody()
    if name not in known:
        return Nobody(f"{name} is no provider known here: {', '.join(sorted(known))}")
    return known[name]() or Nobody(f"{name} is not configured")


def price_of(exact: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(price, basis): the price, else the middle of a range; null where it is withheld."""
    ranged = (low > 0) & (high > 0)
    return F.when(exact > 0, exact).when(ranged, (low + high) / 2), F.when(exact > 0, EXACT).when(ranged, MIDDLE)


def comparables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comparables with a price, its basis and is_estimate; per suburb, state and kind: found, withheld, failed). A withheld price is counted and left out, never read as 0."""
    price, basis = price_of(F.col("price"), F.col("price_from"), F.col("price_to"))
    rows = found.withColumn("basis", basis).withColumn("price", price)
    counts = rows.groupBy("suburb", "state", "kind").agg(
        F.count_if(F.col("error").isNull()).alias("found"), F.count_if(F.col("error").isNull() & F.col("price").isNull()).alias("withheld"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
    return rows.where("error IS NULL AND price IS NOT NULL").withColumn("is_estimate", F.col("basis") == MIDDLE).drop("error", "price_from", "price_to"), counts
