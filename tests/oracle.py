"""Spark rows against DuckDB's, as bags of values by column name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(shown(x) for x in v)
    return str(v)


def same(df, sql, folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    a = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
    b = sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
    assert a == b
