"""Compares a query with its SQL, as rows without order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return repr(x)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if hasattr(x, "as_tuple"):
        return f"{float(x):.9g}"
    return str(x)


def rows_of_sql(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(norm(r[n]) for n in names) for r in df.collect())


def differences(df, folder: str, sql: str) -> str:
    a, b = rows_of_spark(df), rows_of_sql(folder, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"{sum(a[1].values())} and {sum(b[1].values())} rows; only in Spark: {list((a[1] - b[1]).items())[:4]}; only in SQL: {list((b[1] - a[1]).items())[:4]}"
    return ""
