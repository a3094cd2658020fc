"""Running a query's SQL in DuckDB, and rows in a form that compares."""

import os
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def norm(v):
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)
