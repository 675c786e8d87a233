"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column of an inner select is not enough: the optimizer merges projections and copies a struct into every
    place, and every lambda call, that reads one of its fields. The variable of a lambda is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def picked(choices: list[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, in order, as an array.

    Concatenated constant arrays, because filtering an array takes a lambda, and a lambda takes the whole
    projection out of generated code.
    """
    none = F.array().cast("array<string>")
    if not choices:
        return none
    return F.concat(*[F.when(condition, F.array(F.lit(text))).otherwise(none) for condition, text in choices])
