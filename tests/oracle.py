"""Rows of a query against rows of its SQL in DuckDB."""

import os

import duckdb

DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def check(spark, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if sql is None:
        return
    result = connection().execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want
