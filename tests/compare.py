"""Side-by-side run of a query and its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str(v)[:10] if type(v).__name__ in ("date", "datetime") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def same(spark, name, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    got = (con or connect(sf_dir)).sql(sql)
    assert sorted(df.columns) == sorted(got.columns), (name, df.columns, got.columns)
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(got.columns, got.fetchall())
    assert len(a) == len(b), (name, len(a), len(b), a[:3], b[:3])
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (name, len(bad), bad[:3])
    return len(a)
