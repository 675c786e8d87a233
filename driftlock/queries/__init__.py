"""Registered queries: each operator on the driver tables, with its SQL twin where SQL can express it."""

from driftlock.queries import analyze, generate, lineage, lock, sources, text  # noqa: F401
from driftlock.queries.registry import ORACLES, QUERIES  # noqa: F401
