"""LK10: verify only what a change can affect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from driftlock.operators.graph import change_scope, scoped_locks
from driftlock.operators.verify import verify, verify_summary


@dataclass
class ScopedVerification:
    verdicts: DataFrame
    summary: DataFrame
    in_scope: bool


def verify_scoped(
    baseline: DataFrame,
    current: DataFrame,
    keys: list[str],
    units: DataFrame,
    edges: DataFrame,
    changed: DataFrame,
    **options,
) -> ScopedVerification:
    """LK10: change scope, then the locks of affected units, then the verdicts of those locks.

    ``baseline`` and ``current`` carry a ``lock_name`` column, which must be one of the keys. An empty scope
    passes the gate.
    """
    if "lock_name" not in keys:
        raise ValueError("lock_name must be one of the keys")
    affected = change_scope(units, edges, changed)
    in_scope = not affected.isEmpty()
    verdicts = verify(
        scoped_locks(baseline, units, affected), scoped_locks(current, units, affected), keys, **options
    )
    return ScopedVerification(verdicts, verify_summary(verdicts, in_scope=in_scope), in_scope)
