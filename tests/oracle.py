"""Run registered queries and their SQL twins side by side and compare rows exactly."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from driftlock.queries import ORACLES, QUERIES
from driftlock.queries.registry import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value in a form both engines share."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(t[i]) for i in order) for t in tuples]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, sf_dir: str, name: str):
    """(ok, message, seconds)"""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if name not in ORACLES:
        return True, f"rows only: {len(got[1])}", seconds
    cur = connect(sf_dir).execute(ORACLES[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} against {want[0]}", seconds
    if got[1] != want[1]:
        mine, theirs = set(got[1]), set(want[1])
        extra, lacking = sorted(mine - theirs, key=str)[:3], sorted(theirs - mine, key=str)[:3]
        return False, f"{len(got[1])} rows against {len(want[1])}; extra {extra}; lacking {lacking}", seconds
    return True, f"{len(got[1])} rows", seconds


if __name__ == "__main__":
    from driftlock.session import local_session

    sf = sys.argv[1]
    names = [n for n in QUERIES if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]
    spark = local_session("oracle", 8)
    bad = []
    for n in names:
        try:
            ok, message, s = compare(spark, sf, n)
        except Exception as error:  # noqa: BLE001
            ok, message, s = False, f"{type(error).__name__}: {str(error)[:600]}", 0
        if not ok:
            bad.append(n)
        print(("ok  " if ok else "BAD ") + f"{n:40s} {s:6.1f}s {message}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} ok; bad: {bad}")
