"""Compares a query's rows with those of its SQL."""

import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return float(f"{v:.9g}") if isinstance(v, float) else v


def same(spark, query, sql, folder):
    c = duckdb.connect()
    for t in os.listdir(folder):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{t}')")
    df = query(spark, folder)
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(df.columns)
    want = sorted(repr(tuple(plain(dict(zip(names, r))[k]) for k in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(r[k]) for k in cols)) for r in df.collect()) == want
