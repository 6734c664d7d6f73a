"""Spark results against DuckDB: rows as sorted tuples, columns by name, floats to nine digits."""

import datetime
import decimal
import glob
import math
import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for n in NAMES:
        path = f"{sf_dir}/{n}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(files):
            con.sql(f"create view {n} as select * from read_parquet('{files}')")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)


def rows_of_sql(con, sql: str, columns: list[str]) -> list[tuple]:
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(columns), (sorted(rel.columns), sorted(columns))
    at = [rel.columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
