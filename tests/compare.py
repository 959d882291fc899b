"""Rows of a DataFrame and of a DuckDB query in one comparable form."""

import os

import duckdb

DATA = "/root/testdata"


def value(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


def spark_rows(df):
    return table(df.columns, df.collect())


def duck_rows(sql, sf):
    con = duckdb.connect()
    for name in os.listdir(f"{DATA}/{sf}"):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{name}'")
    res = con.execute(sql)
    return table([d[0] for d in res.description], res.fetchall())
