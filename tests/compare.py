"""Spark results against DuckDB's over the same Parquet tables."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def duck(sf_dir: str = DATA):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows: {[x for x in got[1] if x not in want[1]][:2]} {[x for x in want[1] if x not in got[1]][:2]}"

    def close(a, b):
        if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
            return math.isclose(a, b, rel_tol=1e-6, abs_tol=1.01e-6)
        return a == b

    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if not all(map(close, a, b))]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
