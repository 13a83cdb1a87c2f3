"""Results of Spark and of SQL in one comparable form."""

from __future__ import annotations

import math
import os


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def spark_rows(df) -> list:
    columns = sorted(df.columns)
    return sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(folder: str, sql: str) -> tuple[list[str], list]:
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    r = c.sql(sql)
    names = r.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(norm(row[i]) for i in order) for row in r.fetchall()), key=repr)
