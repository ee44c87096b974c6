"""Rows of a Spark query against rows of its SQL in DuckDB, in any order."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return (int(v) if v.is_integer() else round(v, 9)) if isinstance(v, float) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


def same(spark_frame, sql_frame):
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    assert rows(spark_frame) == rows(sql_frame)
