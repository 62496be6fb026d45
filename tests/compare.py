"""Compares queries with their SQL run by DuckDB on the same tables, as sorted rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 4})
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        src = p if p.is_file() else p / "*.parquet"
        con.execute(f"create view {p.stem} as select * from read_parquet('{src}')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "__float__") and not isinstance(v, str):
        return round(float(v), 6)
    return list(map(_plain, v)) if isinstance(v, (list, tuple)) else str(v)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """'' if the rows agree, else what differs."""
    cols = sorted(df.columns)
    got = con.execute(sql)
    theirs = [d[0] for d in got.description]
    if sorted(theirs) != cols:
        return f"columns {cols} and {sorted(theirs)}"
    order = [theirs.index(c) for c in cols]
    b = sorted(([_plain(r[i]) for i in order] for r in got.fetchall()), key=repr)
    a = sorted(([_plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in b][:3]}; only there {[x for x in b if x not in a][:3]}" if len(a) + len(b) < 5000 else f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows, as {str(bad[0])[:600]}" if bad else ""
