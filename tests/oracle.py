"""Comparison of a query's rows with those of its oracle SQL."""

from __future__ import annotations

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v) -> str:
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if v is None or str(v) in ("NaT", "<NA>", "nan"):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


def check(spark, sf_dir, query, sql: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
