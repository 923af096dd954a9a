"""Comparison of a query with SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "/root/testdata/sf0.001"


def connection(folder: str = TABLES):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(v) -> str:
    if isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") == "b":
        return str(bool(v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and pd.isna(v):
        return "∅"
    return f"{float(v):.6f}" if isinstance(v, int | float) or getattr(getattr(v, "dtype", None), "kind", "") in "iuf" and hasattr(v, "dtype") else str(v)


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))
