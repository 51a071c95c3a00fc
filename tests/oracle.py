"""Compares a Spark result with DuckDB's, rows in any order."""

import numbers
import os

import duckdb
import pandas as pd


def connect(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in sorted(os.listdir(sf)):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


def normal(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, numbers.Number) and not isinstance(v, bool):  # pandas turns whole numbers with nulls into floats
            return f"{float(v):.6f}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


def same(spark_df, duck, sql):
    a, b = spark_df.toPandas(), duck.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)
