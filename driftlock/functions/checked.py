"""Expressions that cannot fail: each operation takes its ``try_`` form and keeps the error class next to the value.

A transform is written with ordinary operators over ``CheckedRow``. What it builds is one column, a struct of the value
and the error, in which every operand is bound once, so a formula is as large as it is written; a value that is written
several times is named by ``bind``. The error is that of
the operand that failed first, in the order in which the operands are written, and only a branch that is taken can fail.
Error classes are those that Spark itself raises under ANSI. Spark's analyser resolves some 40 operations that are nested in
each other; a deeper formula needs ``spark.sql.analyzer.maxIterations`` raised, or is given in parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlock.functions.bind import let

# Classes and messages of the errors.
OVERFLOW = "ARITHMETIC_OVERFLOW: overflow"
OUT_OF_RANGE = "NUMERIC_VALUE_OUT_OF_RANGE: the value does not fit the decimal type"
DIVIDE_BY_ZERO = "DIVIDE_BY_ZERO: division by zero"
REMAINDER_BY_ZERO = "REMAINDER_BY_ZERO: remainder by zero"
BAD_INDEX = "INVALID_ARRAY_INDEX: the index is out of bounds"
BAD_INPUT, CAST_OVERFLOW, CAST_OUT_OF_RANGE = "CAST_INVALID_INPUT", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE"
BAD_TIMESTAMP = "CANNOT_PARSE_TIMESTAMP"


def _none() -> Column:
    return F.lit(None).cast("string")


def _pair(value: Column, error: Column) -> Column:
    return F.struct(value.alias("value"), error.alias("error"))


@dataclass(frozen=True, eq=False)
class Checked:
    """A value and why there is none: a struct of the value and null, or of null and ``"<class>: <message>"``."""

    df: DataFrame
    pair: Column
    kind: T.DataType

    @property
    def value(self) -> Column:
        return self.pair["value"]

    @property
    def error(self) -> Column:
        return self.pair["error"]

    def _kind(self, column: Column) -> T.DataType:
        """The type of an expression; it is analysed, nothing runs."""
        return self.df.select(column.alias("v")).schema["v"].dataType

    def _lift(self, other: object) -> Checked:
        if isinstance(other, Checked):
            return other
        value = other if isinstance(other, Column) else F.lit(other)
        return Checked(self.df, _pair(value, _none()), self._kind(value))

    def bind(self, body: Callable[[Checked], Checked]) -> Checked:
        """``body`` of this value, computed once however often it is used there: a named step of a long formula."""
        kinds = []

        def bound(pair: Column) -> Column:
            made = body(Checked(self.df, pair, self.kind))
            kinds.append(made.kind)
            return made.pair

        pair = let(self.pair, bound)
        return Checked(self.df, pair, kinds[0])

    def _of(self, others: list[Checked], result: Callable[..., Column], failure: Callable[..., Column] | None = None) -> Checked:
        """``result(values…)``, with the first error of the operands, or ``failure(result, values…)`` if they have none."""
        operands = F.struct(*[o.pair.alias(f"o{i}") for i, o in enumerate([self, *others])])
        # Nulls of the operands' types tell the type of the result.
        kind = self._kind(result(*[F.lit(None).cast(o.kind) for o in (self, *others)]))

        def outcome(bound: Column) -> Column:
            values = [bound[f"o{i}"]["value"] for i in range(len(others) + 1)]
            errors = [bound[f"o{i}"]["error"] for i in range(len(others) + 1)]
            # The operation itself is written twice: cheaper than another level of binding.
            value = result(*values)
            error = F.coalesce(*errors, failure(value, *values) if failure else _none())
            return _pair(F.when(error.isNull(), value), error)

        return Checked(self.df, let(operands, outcome), kind)

    # --- arithmetic -------------------------------------------------------------------------------------------

    def _arithmetic(self, other: object, form: Callable[[Column, Column], Column], zero: str | None = None, swap: bool = False) -> Checked:
        a, b = self, self._lift(other)
        if swap:
            a, b = b, a
        kind = self._kind(form(F.lit(None).cast(a.kind), F.lit(None).cast(b.kind)))
        lost = OUT_OF_RANGE if isinstance(kind, T.DecimalType) else OVERFLOW

        def failure(result: Column, x: Column, y: Column) -> Column:
            # Null operands give null; else only a zero divisor or an overflow leaves null. Doubles never overflow.
            told = F.when(x.isNull() | y.isNull() | result.isNotNull(), _none())
            return (told if zero is None else told.when(y == 0, zero)).otherwise(lost)

        return a._of([b], form, failure)

    def __add__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_add)

    def __radd__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_add, swap=True)

    def __sub__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_subtract)

    def __rsub__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_subtract, swap=True)

    def __mul__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_multiply)

    def __rmul__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_multiply, swap=True)

    def __truediv__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_divide, DIVIDE_BY_ZERO)

    def __rtruediv__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_divide, DIVIDE_BY_ZERO, swap=True)

    def __mod__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_mod, REMAINDER_BY_ZERO)

    def __rmod__(self, other: object) -> Checked:
        return self._arithmetic(other, F.try_mod, REMAINDER_BY_ZERO, swap=True)

    def __neg__(self) -> Checked:
        return self._lift(F.lit(0).cast(self.kind)) - self

    def __abs__(self) -> Checked:
        """The magnitude; that of the least whole number does not fit."""
        return when(self < 0, -self).otherwise(self)

    # --- comparisons and logic: they can't fail, but their operands can ---------------------------------------

    def __eq__(self, other: object) -> Checked:  # type: ignore[override]
        return self._of([self._lift(other)], lambda a, b: a == b)

    def __ne__(self, other: object) -> Checked:  # type: ignore[override]
        return self._of([self._lift(other)], lambda a, b: a != b)

    def __lt__(self, other: object) -> Checked:
        return self._of([self._lift(other)], lambda a, b: a < b)

    def __le__(self, other: object) -> Checked:
        return self._of([self._lift(other)], lambda a, b: a <= b)

    def __gt__(self, other: object) -> Checked:
        return self._of([self._lift(other)], lambda a, b: a > b)

    def __ge__(self, other: object) -> Checked:
        return self._of([self._lift(other)], lambda a, b: a >= b)

    def _logic(self, other: object, deciding: bool, form: Callable[[Column, Column], Column]) -> Checked:
        """The second operand counts only if the first does not decide."""
        b = self._lift(other)
        decided = _pair(F.lit(deciding), _none())

        def outcome(a: Column) -> Column:
            both = let(b.pair, lambda y: _pair(F.when(y["error"].isNull(), form(a["value"], y["value"])), y["error"]))
            failed = _pair(F.lit(None).cast("boolean"), a["error"])
            return F.when(a["error"].isNotNull(), failed).when(a["value"] == deciding, decided).otherwise(both)

        return Checked(self.df, let(self.pair, outcome), T.BooleanType())

    def __and__(self, other: object) -> Checked:
        return self._logic(other, False, lambda a, b: a & b)

    def __or__(self, other: object) -> Checked:
        return self._logic(other, True, lambda a, b: a | b)

    def __invert__(self) -> Checked:
        return self._of([], lambda a: ~a)

    def is_null(self) -> Checked:
        return self._of([], lambda a: a.isNull())

    # --- conversions and access -------------------------------------------------------------------------------

    def cast(self, kind: str | T.DataType) -> Checked:
        """The value in another type; one that doesn't convert is an error that shows it."""
        target = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
        numeric = isinstance(self.kind, T.NumericType)
        name = BAD_INPUT if not numeric else CAST_OUT_OF_RANGE if isinstance(target, T.DecimalType) else CAST_OVERFLOW

        def failure(result: Column, value: Column) -> Column:
            shown = F.concat(F.lit(f"{name}: '"), value.cast("string"), F.lit(f"' is no {target.simpleString()}"))
            return F.when(value.isNotNull() & result.isNull(), shown)

        return self._of([], lambda v: v.try_cast(target), failure)

    def timestamp(self, pattern: str) -> Checked:
        """The moment that a text states in the pattern."""

        def failure(result: Column, value: Column) -> Column:
            shown = F.concat(F.lit(f"{BAD_TIMESTAMP}: '"), value, F.lit(f"' is not in the form {pattern}"))
            return F.when(value.isNotNull() & result.isNull(), shown)

        return self._of([], lambda v: F.try_to_timestamp(v, F.lit(pattern)), failure)

    def __getitem__(self, index: object) -> Checked:
        """An element of an array, from 0, a field of a struct, or the value of a key in a map, null if there is none."""
        kind = self.kind
        if isinstance(kind, T.StructType):
            return self._of([], lambda v: v[index])
        at = self._lift(index)
        if isinstance(kind, T.MapType):
            return self._of([at], F.try_element_at)
        outside = lambda _, v, i: F.when((i < 0) | (i >= F.size(v)), BAD_INDEX)
        return self._of([at], F.get, lambda r, v, i: F.when(v.isNotNull(), outside(r, v, i)))

    def apply(self, form: Callable[..., Column], *others: object) -> Checked:
        """Any function that can't fail, over this and other operands."""
        return self._of([self._lift(o) for o in others], form)

    def refuse(self, condition: object, kind: str, message: str | Column) -> Checked:
        """This value, but an error of one's own where the condition holds."""
        text = F.concat(F.lit(kind + ": "), message if isinstance(message, Column) else F.lit(message))
        return self._of([self._lift(condition)], lambda v, _: v, lambda _, v, holds: F.when(holds, text))

    def __bool__(self) -> bool:
        raise TypeError("a checked value has no truth in Python: use &, |, ~ and when()")


class _When:
    def __init__(self, branches: list[tuple[Checked, object]]):
        self.branches = branches

    def when(self, condition: Checked, value: object) -> _When:
        return _When([*self.branches, (condition, value)])

    def otherwise(self, value: object) -> Checked:
        """The value of the first branch whose condition holds; errors of later conditions and branches don't count."""
        head = self.branches[0][0]
        values = [head._lift(v) for _, v in self.branches] + [head._lift(value)]
        # Branches of different types have a common one, as those of a plain case expression.
        shown = F.when(F.lit(True), F.lit(None).cast(values[0].kind))
        for v in values[1:]:
            shown = shown.when(F.lit(True), F.lit(None).cast(v.kind))
        kind = head._kind(shown)
        pairs = [let(v.pair, lambda p: _pair(p["value"].cast(kind), p["error"])) for v in values]
        out = pairs[-1]
        for (condition, _), taken in reversed(list(zip(self.branches, pairs))):
            out = let(condition.pair, _branch(kind, taken, out))
        return Checked(head.df, out, kind)


def _branch(kind: T.DataType, taken: Column, rest: Column) -> Callable[[Column], Column]:
    def branch(condition: Column) -> Column:
        failed = _pair(F.lit(None).cast(kind), condition["error"])
        return F.when(condition["error"].isNotNull(), failed).when(condition["value"], taken).otherwise(rest)

    return branch


def when(condition: Checked, value: object) -> _When:
    return _When([(condition, value)])


class CheckedRow:
    """The columns of an input row, by name."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getitem__(self, name: str) -> Checked:
        if name not in self._df.columns:
            raise KeyError(name)
        return Checked(self._df, _pair(F.col(f"`{name}`"), _none()), self._df.schema[name].dataType)
