"""Rows of a Spark query beside those of its DuckDB query."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    return str(x)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(v[i]) for i in order) for v in values), key=repr)


def expected(sql, sf=SF):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), rows(names, got.fetchall())


def check(spark, query, sql, sf=SF):
    df = query(spark, sf)
    names, want = expected(sql, sf)
    assert sorted(df.columns) == names
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
