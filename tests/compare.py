"""Multiset comparison of a DataFrame with an independent engine's rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, Decimal) and x == x.to_integral_value():
        return str(int(x))
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.9g}"  # the sign of zero stays
    if isinstance(x, int):
        return str(x)  # to the last digit
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return x.date()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return x


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and the same rows with the same counts."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want, have = rows(names, got.fetchall()), rows(df.columns, df.collect())
    if want != have:
        return f"{sum(have.values())} rows against {sum(want.values())}; extra {list((have - want).items())[:3]}; missing {list((want - have).items())[:3]}"
    return ""
