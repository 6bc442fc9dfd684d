"""Holds a Spark result against DuckDB on the same Parquet tables: names, rows and values, in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _plain(v.item())
    return v


def rows(pandas_frame) -> list[tuple]:
    names = sorted(pandas_frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in pandas_frame[names].itertuples(index=False)), key=repr)


def assert_same(spark_frame, con, sql: str) -> None:
    want, got = con.sql(sql).df(), spark_frame.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
