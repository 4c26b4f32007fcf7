"""Comparison of a query with its SQL, as multisets of rows."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(plain(tuple(r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def of_sql(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(plain(tuple(r[i] for i in order))) for r in cur.fetchall())
