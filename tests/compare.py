"""Runs a query and its SQL over the same tables and compares all rows."""

import math
import os
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"


def duck(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    """A value that compares and sorts across both engines; floats to five places."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in rows)


def assert_same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    if got[1] != want[1]:
        more, less = got[1] - want[1], want[1] - got[1]
        close = len(more) == len(less) and all(near(a, b) for a, b in zip(sorted(more, key=repr), sorted(less, key=repr), strict=True))
        assert close, f"only in Spark {list(more)[:3]}, only in SQL {list(less)[:3]}; {sum(more.values())} and {sum(less.values())} rows"


def near(a: tuple, b: tuple) -> bool:
    return all(abs(x - y) < 3e-5 if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))
