"""Spark's rows against DuckDB's."""

import datetime
import decimal
import math
import os
from glob import glob

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf, sql):
    con = duckdb.connect()
    for path in glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql)
    return table([d[0] for d in cursor.description], cursor.fetchall())


def sparked(df):
    return table(df.columns, df.collect())
