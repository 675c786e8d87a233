"""Run the queries of this subpackage and their SQL twins side by side."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import connect, rows  # noqa: E402

from driftlock.llm.queries import ORACLES, QUERIES  # noqa: E402


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
        return False, f"{len(got[1])} rows against {len(want[1])}; extra {len(mine - theirs)} {extra}; lacking {lacking}", seconds
    return True, f"{len(got[1])} rows", seconds


if __name__ == "__main__":
    from driftlock.session import local_session

    session = local_session("oracle", 8)
    for name in [n for n in QUERIES if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]:
        ok, message, s = compare(session, sys.argv[1], name)
        print(("ok  " if ok else "BAD ") + f"{name:40s} {s:6.1f}s {message}", flush=True)
