"""Registered queries against their SQL in DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb


def views(at):
    con = duckdb.connect()
    for p in glob.glob(at + "/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def norm(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def same(spark, con, query, sql, at):
    df = query(spark, at)
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    place = [want.columns.index(c) for c in names]
    got = Counter(tuple(norm(r[c]) for c in names) for r in df.collect())
    assert got == Counter(tuple(norm(r[i]) for i in place) for r in want.fetchall())
