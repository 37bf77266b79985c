"""Compares a query with its SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if pd.isna(v):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.6g}"
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(shown(v) for v in r) for r in df[names].itertuples(index=False, name=None))


def sql_frame(sql: str, sf: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.sql(sql).df()


def assert_same(df, sql: str, sf: str):
    assert rows(df.toPandas()) == rows(sql_frame(sql, sf))
