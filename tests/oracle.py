"""Comparing a Spark query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted(map(tuple, frame[names].astype(str).to_numpy().tolist()))


def assert_same(df, sql: str, sf_dir: str) -> None:
    got, wanted = df.toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
