"""Rows of a query and of its SQL in one comparable form."""

import decimal
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir=SMALL):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.8g}")
    if isinstance(x, int):
        return float(f"{x:.8g}") if abs(x) < 2**40 else x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def same(df, sql, c):
    got = df.collect()
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    a = sorted((tuple(plain(r[k]) for k in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[k]) for k in order) for r in want), key=repr)
    assert a == b
