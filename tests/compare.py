"""Order-free comparison of Spark rows with DuckDB rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime | dt.date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(name, df, con, sql):
    """None if both give the same rows, else a short account of the difference."""
    cursor = con.execute(sql)
    wanted_columns = [c[0] for c in cursor.description]
    wanted = normal(cursor.fetchall(), wanted_columns)
    got = normal(df.collect(), df.columns)
    if sorted(df.columns) != sorted(wanted_columns):
        return f"{name}: columns {sorted(df.columns)} != {sorted(wanted_columns)}"
    if got == wanted:
        return None
    extra = [r for r in got if r not in set(wanted)][:1]
    missing = [r for r in wanted if r not in set(got)][:1]
    return f"{name}: {len(got)} rows, wanted {len(wanted)}; extra {str(extra)[:600]}; missing {str(missing)[:600]}"
