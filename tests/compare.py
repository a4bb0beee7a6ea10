"""Holds a query's rows against its SQL: same columns, same rows, doubles to a relative 1e-6."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if hasattr(x, "asDict"):
            x = x.asDict()
        if isinstance(x, dict):
            return tuple(sorted((k, plain(v)) for k, v in x.items()))
        if isinstance(x, (list, tuple)):
            return tuple(map(plain, x))
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
            return 0.0 if x == 0 else float(f"{float(x):.6g}") if math.isfinite(x) else str(x)
        return str(x)

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same rows, else what differs."""
    found = con.execute(sql)
    names, theirs = [d[0] for d in found.description], found.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    mine, theirs = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]), rows_of(names, theirs)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    other = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    close = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=2e-5, abs_tol=1e-9))
    other = [(a, b) for a, b in other if not all(map(close, a, b))]
    return f"{len(other)} of {len(mine)} rows: {other[0]}" if other else ""
