"""Compare a query with its SQL, order-insensitively, as sorted rows of rounded values."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb


def normal(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


def connected(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def assert_same(df, connection, sql: str) -> int:
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    result = connection.execute(sql)
    columns = [x[0] for x in result.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = sorted((tuple(normal(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert got == want
    return len(got)
