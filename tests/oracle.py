"""Results of Spark and DuckDB over the same parquet, as sorted rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(names, data):
    """Sorted column names and sorted rows."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def of_spark(df):
    return rows(df.columns, df.collect())


def of_duckdb(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{at}')")
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())
