"""Runs a query and its SQL over the same tables and compares the rows."""

import decimal
import os
from collections import Counter

import duckdb


def _norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else float(f"{float(v):.10g}")
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def connect(folder):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return c


def assert_same(df, sql, db):
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    r = db.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(_norm(x[i]) for i in at) for x in r.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
