"""Runs a query beside its SQL, as the driver does: rows, names and an order-free comparison of values."""

from __future__ import annotations

import datetime
import decimal
import os
import re

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else repr(round(float(v), 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, query, sql: str, sf_dir: str = SF, con=None):
    """None if both give the same rows, else a short report."""
    df = query(spark, sf_dir)
    n1, r1 = rows(df.columns, [tuple(r) for r in df.collect()])
    con = con or connect(sf_dir)
    got = con.execute(sql)
    n2, r2 = rows([c[0] for c in got.description], got.fetchall())
    if n1 != n2:
        return f"columns {n1} and {n2}"
    if r1 != r2:
        a, b = set(r1), set(r2)
        return f"{len(r1)} and {len(r2)} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return None


def ident(name: str) -> bool:
    return bool(re.fullmatch(r"[a-z]\w*", name))
