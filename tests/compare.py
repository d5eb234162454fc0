"""Rows of a query and of its SQL, made comparable."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    raise TypeError(type(v))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(f"{type(x).__name__}{x}" for x in r))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), ordered(tuple(plain(r[i]) for i in at) for r in found.fetchall())
