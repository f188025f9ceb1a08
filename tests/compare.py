"""Spark results against DuckDB's for the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def same(df, relation) -> None:
    cols = sorted(df.columns)
    assert sorted(relation.columns) == cols
    at = [relation.columns.index(c) for c in cols]
    left = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    right = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    assert left == right
