"""Compare a query with its SQL on the same tables: rows, names and values, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat() if hasattr(x, "tzinfo") else x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, con) -> str:
    """Empty when both agree."""
    got = df.collect()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a == b:
        return ""
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; {[x for x in a if x not in b][:2]} {[x for x in b if x not in a][:2]}"
    return f"{sum(x != y for x, y in zip(a, b))} of {len(a)} rows differ: " + "; ".join(f"{x} | {y}" for x, y in zip(a, b) if x != y)[:900]
