"""Compares a query with its SQL on the same tables."""

import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def differences(spark, query, sql, folder):
    df = query(spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(folder):
        con.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    other = con.sql(sql)
    assert sorted(other.columns) == columns
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    at = [other.columns.index(c) for c in columns]
    b = sorted(repr(tuple(plain(r[i]) for i in at)) for r in other.fetchall())
    return [] if a == b else [x for x in a if x not in set(b)][:3] + ["--"] + [x for x in b if x not in set(a)][:3] + [f"{len(a)} {len(b)}"]
