"""Spark result against DuckDB result: types, row counts and values."""

import decimal
import glob
import math
import os
import time

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return repr(v)


def compare(spark, con, fn, sql, sf):
    """A list of differences; empty if the results are equal."""
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    res = con.execute(sql)
    want_cols = [(d[0], str(d[1])) for d in res.description]
    want = res.fetchall()
    problems = []
    got_cols = df.columns
    if sorted(got_cols) != sorted(c for c, _ in want_cols):
        return [f"columns {sorted(got_cols)} != {sorted(c for c, _ in want_cols)}"], took
    types = dict(df.dtypes)
    for c, t in want_cols:
        if KINDS.get(types[c], types[c]) != t.upper():
            problems.append(f"type of {c}: {types[c]} / {t}")
    order = sorted(got_cols)
    gi, wi = [got_cols.index(c) for c in order], [[c for c, _ in want_cols].index(c) for c in order]
    a = sorted(tuple(_plain(r[i]) for i in gi) for r in got)
    b = sorted(tuple(_plain(r[i]) for i in wi) for r in want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        left, right = set(a), set(b)
        problems.append(f"only spark {sorted(left - right)[:3]} only duckdb {sorted(right - left)[:3]} of {len(left - right)}/{len(right - left)}")
    return problems, took
