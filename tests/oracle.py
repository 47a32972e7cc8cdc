"""Holds a query's rows against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (float, np.floating)) and v == int(v):
        return str(int(v))
    return str(v)


def rows(frame, columns):
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    want = c.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
    return len(got)
