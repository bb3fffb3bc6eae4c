"""Compare queries with their SQL in DuckDB: row count, column names and values in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    return v if isinstance(v, (int, str)) else str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def differences(spark_df, sql: str, c: duckdb.DuckDBPyConnection, most: int = 3) -> list[str]:
    got = spark_df.collect()
    made = c.execute(sql)
    names = [x[0] for x in made.description]
    want = made.fetchall()
    out = []
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    if len(got) != len(want):
        out.append(f"{len(got)} rows and {len(want)}")
    a, b = rows(spark_df.columns, got), rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    out += [f"{len(bad)} differ: {x} and {y}" for x, y in bad[:most]]
    return out
