"""The driver's comparison: columns by name, rows in any order, floats to six places."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        con.sql(f"create view {f.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6))
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def of_spark(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def of_duck(con, sql):
    got = con.execute(sql)
    return canonical([c[0] for c in got.description], got.fetchall())
