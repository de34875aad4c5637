"""Compare a Spark result with a DuckDB result, row order aside."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    return str(value)


def rows_of(table) -> tuple[list[str], Counter]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, Counter(tuple(_cell(v) for v in row) for row in zip(*columns))


def compare(spark_table, duck_table) -> str | None:
    """None if equal, else what differs."""
    got_names, got = rows_of(spark_table)
    want_names, want = rows_of(duck_table)
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} vs {sum(want.values())} rows; extra {extra}; missing {missing}"[:1500]
    if not got:
        return "both are empty"
    return None


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted(map(tuple, df.collect()), key=repr)
