"""Runs a query and its SQL and compares their rows."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connected(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(connection, sql):
    r = connection.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
