"""Compare registered queries with their SQL: ``python -m tests.compare [sf_dir] [query …]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def compare(spark, con, sf: str, query, sql: str | None):
    """(ok, message)"""
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} rows, want {len(want)}; extra {extra}; missing {missing}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from tests.conftest import make_session

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), duck(sf)
    for name, query in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            ok, message = compare(spark, con, sf, query, e.oracle_sql().get(name))
        except Exception as problem:  # noqa: BLE001
            ok, message = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {message[:1500]}", flush=True)
