"""Every query of the library proper, by name, with its SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import attribution, audits, catalogue, evidence, files, inputs, lines, publish, repairs, reports, research, rows, sheets, shortlist, steps
from .session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _ready(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return f(spark, sf_dir)

    return run


_MODULES = (catalogue, shortlist, evidence, lines, inputs, repairs, audits, rows, attribution, publish, sheets, steps, reports, research, files)
QUERIES: dict[str, Query] = {name: _ready(f) for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["peer_best_value"](spark, sf_dir)
