"""Runs a registered query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    return cols, sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
