"""Compare registered queries with their SQL checks, as the driver does."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from turnlake import fixtures as fx

ALL = [*fx.TABLES, "region", "nation", "customer", "supplier", "part", "embeddings"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ALL:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> tuple[str, float]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows {len(got)}", took
    con = con or connect(sf_dir)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", took
    if got != want:
        bad = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        return (
            f"DIFF {len(got)} vs {len(want)} cols {sorted(names)}\n   spark {got[bad] if bad < len(got) else None}\n   check {want[bad] if bad < len(want) else None}",
            took,
        )
    return f"ok {len(got)}", took


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from turnlake.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark = local_session(8)
    con, checks = connect(sf), oracle_sql()
    for name, fn in queries().items():
        if only and name not in only:
            continue
        try:
            result, took = compare(spark, sf, name, fn, checks.get(name), con)
        except Exception as e:  # noqa: BLE001
            result, took = f"ERROR {type(e).__name__} {str(e)[:700]}", 0.0
        print(f"{name:24s} {took:6.1f}s {result}", flush=True)
