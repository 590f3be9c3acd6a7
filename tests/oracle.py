"""Holds every query against its SQL: ``python tests/oracle.py [sf_dir] [prefix...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return db


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Values by column name, sorted, as text that both engines agree on."""
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x).removesuffix(" 00:00:00") if not isinstance(x, (list, tuple)) else str([plain(y) for y in x])

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None))


def compare(spark, db, f, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    got, want = f(spark, sf_dir).toPandas(), db.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows, not {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {str(bad[0])[:400]}" if bad else ""


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as entry

    spark, sf = session(), sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    db, sql = database(sf), entry.oracle_sql()
    for name, f in entry.queries().items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        t = time.time()
        try:
            said = compare(spark, db, f, sql[name], sf) if name in sql else f"rows only: {f(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001  this is a report
            said = f"ERROR {str(e)[:600]}"
        print(f"{name:28} {time.time() - t:5.1f}s {said or 'ok'}", flush=True)
