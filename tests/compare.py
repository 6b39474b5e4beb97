"""Runs a query beside its SQL and compares the rows."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def connect(sf=SF):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    return con


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)


def sql_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
