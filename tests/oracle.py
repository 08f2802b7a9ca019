"""Compares a query with its SQL on the same tables: column names, row count, values in any order."""

import os

import duckdb
import pandas as pd


def _plain(v):
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str([_plain(x) for x in v])
    if v is None or pd.isna(v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.6g}"
    return str(v)


def _rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(_plain(v) for v in row) for row in pdf[columns].itertuples(index=False))


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def assert_same(spark, connection, sf_dir, query, sql):
    got, want = _rows(query(spark, sf_dir).toPandas()), _rows(connection.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
