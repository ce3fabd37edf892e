"""Compares a query with its DuckDB twin."""

import glob
import os

import duckdb


def views(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df, columns):
    def plain(v):
        missing = v is None or v != v
        return None if missing else round(float(v), 9) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else v

    return sorted((tuple(str(plain(v)) for v in r) for r in df[columns].astype(object).itertuples(index=False)))


def assert_twins(spark, sf, query, sql):
    a, b = query(spark, sf).toPandas(), views(sf).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert rows(a, columns) == rows(b, columns)
