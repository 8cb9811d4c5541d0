"""Rows of Spark and DuckDB in a comparable form."""

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())


def duckdb_rows(con, sql):
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, Counter(repr([plain(r[i]) for i in at]) for r in found.fetchall())


_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def spark_types(df):
    return {c: _TYPES.get(t, t) for c, t in df.dtypes}


def duckdb_types(con, sql):
    found = con.sql(sql)
    return dict(zip(found.columns, map(str, found.types), strict=True))
