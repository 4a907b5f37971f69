"""Compare a query with its SQL, run by DuckDB on the same tables."""

import datetime
import decimal
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def agree(spark, query, sql):
    df = query(spark, SF)
    ours = rows_of(df.columns, df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert ours == rows_of(columns, out.fetchall())
    assert ours
