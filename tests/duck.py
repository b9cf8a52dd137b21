"""Runs a query and its SQL on one folder of tables and compares them row by row."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{p}'")
    return con


def same(df, sql, sf_dir):
    want = connection(sf_dir).sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(df.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
