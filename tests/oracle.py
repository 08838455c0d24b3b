"""Compare a query with its SQL in DuckDB, order aside."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def differing(df, sql, folder):
    """Rows only in Spark and rows only in DuckDB, up to three each."""
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    right = sorted(repr(tuple(plain(row[i]) for i in order)) for row in found.fetchall())
    left = sorted(repr(tuple(plain(x) for x in row)) for row in df.collect())
    if left == right:
        return [], []
    return sorted(set(left) - set(right))[:3] or left[:1], sorted(set(right) - set(left))[:3] or right[:1]
