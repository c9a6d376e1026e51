"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x


def same(df, connection, sql: str) -> str:
    """Empty if the rows agree, or what differs."""
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    wanted = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns}, not {names}"
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    order = lambda rows: sorted((tuple(map(_plain, r)) for r in rows), key=repr)
    a, b = order(wanted), order(got)
    if a == b:
        return ""
    left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{len(a)} rows wanted, {len(b)} found; wanted alone {left}; found alone {right}"
