"""Run a registered query and its check SQL and compare schema and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    return sorted(rows, key=repr)


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a DuckDB result; empty when equal."""
    found = []
    got_types = {c: _TYPES.get(t, t) for c, t in df.dtypes}
    rel = con.sql(sql)
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if got_types != want_types:
        found.append(f"types: {sorted(got_types.items() ^ want_types.items())}")
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want = _rows(rel.columns, rel.fetchall())
    if len(got) != len(want):
        found.append(f"rows: {len(got)} != {len(want)}")
    if got != want:
        extra = [(g, w) for g, w in zip(got, want) if g != w]
        found.append(f"{len(extra)} rows differ, first {extra[:2]}")
    return found
