"""Runs registered queries beside their SQL and reports differences."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


# Spark type → DuckDB type of the same column.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns, types and rows (in any order) agree exactly."""
    expected = con.execute(sql)
    names = [c[0] for c in expected.description]
    types = {c[0]: str(c[1]) for c in expected.description}
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} != {sorted(names)}"
    wrong = {n: (t, types[n]) for n, t in result.dtypes if TYPES.get(t, t) != types[n]}
    if wrong:
        return f"types {wrong}"
    theirs = _bag(names, expected.fetchall())
    ours = _bag(result.columns, result.collect())
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        return (
            f"{sum(ours.values())} vs {sum(theirs.values())} rows, {sum(extra.values())} differ; "
            f"e.g. {list(extra)[:2]} / {list(missing)[:2]}"
        )
    return None
