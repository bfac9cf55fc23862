"""Rows of a query against the rows of its SQL."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


def check(spark, con, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    other = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert mine == other, (list((mine - other).items())[:2], list((other - mine).items())[:2])
