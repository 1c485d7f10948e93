"""Compares a Spark query with its SQL twin in DuckDB."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0 if math.isfinite(value) else str(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)


def sql_rows(con, sql, columns):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
