"""Runs a query and its SQL over the same tables and compares names, rows and values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "as_tuple"):
        return float(x) if x % 1 else int(x)
    return tuple(map(plain, x)) if isinstance(x, list) else x


def counted(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def difference(spark, name: str, query, sql: str, sf_dir: str, con) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    said = con.execute(sql)
    names = [c[0] for c in said.description]
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = counted(df.columns, df.collect()), counted(names, said.fetchall())
    if ours != theirs:
        return f"{name}: {sum(ours.values())} and {sum(theirs.values())} rows; {list((ours - theirs).items())[:3]} against {list((theirs - ours).items())[:3]}"
    return None if ours else f"{name}: no rows"
