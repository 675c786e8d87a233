"""PRJ11: redaction of secret-shaped values."""

from __future__ import annotations

from dataclasses import dataclass

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlock import vocab
from driftlock.functions.bind import let


@dataclass(frozen=True)
class SecretShape:
    """One shape of secret: text that must be present, the pattern, and its replacement."""

    name: str
    needles: tuple[str, ...]
    pattern: str
    replacement: str


_MARK = vocab.REDACTED
_SECRET_WORD = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|client[_-]?secret)"


def _value(quote: str) -> str:
    """A value that is not empty, and its closing quote.

    Escapes are stepped over, however many: a possessive repetition keeps no place to return to. Where that finds no
    closing quote, the value ends at the first quote, as if it had no escapes.
    """
    plain = rf"[^{quote}\\]*+"
    return rf"(?!{quote})(?:{plain}(?:\\[\s\S]{plain})*+|[^{quote}]+){quote}"


_DOUBLE, _SINGLE = _value('"'), _value("'")

# Whole blocks and self-describing tokens first, so that an assignment around one is not counted again.
SHAPES = (
    SecretShape(
        "pem",
        ("-----BEGIN",),
        r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
        _MARK,
    ),
    SecretShape("jwt", ("eyJ",), r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}", _MARK),
    SecretShape("aws", ("AKIA", "ASIA"), r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", _MARK),
    SecretShape("sk", ("sk-",), r"\bsk-[A-Za-z0-9_-]{16,}", _MARK),
    SecretShape(
        "quoted",
        ('"',),
        rf'(?i)({_SECRET_WORD}"?\s*[:=]\s*)"(?!\[REDACTED\]"){_DOUBLE}',
        rf'$1"{_MARK}"',
    ),
    SecretShape(
        "single-quoted",
        ("'",),
        rf"(?i)({_SECRET_WORD}'?\s*[:=]\s*)'(?!\[REDACTED\]'){_SINGLE}",
        rf"$1'{_MARK}'",
    ),
    SecretShape(
        "connection",
        ("=",),
        r"(?i)\b((?:password|pwd)\s*=\s*)(?!\[REDACTED\])[^;\"'\s]+",
        rf"$1{_MARK}",
    ),
)


def _present(text: Column, shape: SecretShape) -> Column:
    return reduce(or_, [F.coalesce(F.contains(text, F.lit(n)), F.lit(False)) for n in shape.needles])


def scrubbed_text(text: Column) -> Column:
    """``struct(text, hits)`` of one string, all shapes applied in turn."""

    def step(shape: SecretShape):
        def apply(s: Column) -> Column:
            seen, now = _present(s["text"], shape), s["text"]
            return F.struct(
                F.when(seen, F.regexp_replace(now, shape.pattern, shape.replacement)).otherwise(now).alias("text"),
                (s["hits"] + F.when(seen, F.regexp_count(now, F.lit(shape.pattern))).otherwise(0)).alias("hits"),
            )

        return apply

    state = F.struct(text.alias("text"), F.lit(0).alias("hits"))
    for shape in SHAPES:
        state = let(state, step(shape))
    return state


def holds_text(dtype: T.DataType) -> bool:
    """Whether a type is a string or holds strings at any depth."""
    if isinstance(dtype, T.StructType):
        return any(holds_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_text(dtype.keyType) or holds_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def _leaves(value: Column, dtype: T.DataType) -> Column:
    """All strings of a nested value as one array."""
    none = F.array().cast("array<string>")
    if isinstance(dtype, T.StringType):
        return F.array(value)
    if isinstance(dtype, T.StructType):
        parts = [_leaves(value[f.name], f.dataType) for f in dtype.fields if holds_text(f.dataType)]
    elif isinstance(dtype, T.ArrayType):
        parts = [F.flatten(F.transform(value, lambda x: _leaves(x, dtype.elementType)))]
    else:
        keys, values = F.map_keys(value), F.map_values(value)
        parts = []
        if holds_text(dtype.keyType):
            parts.append(F.flatten(F.transform(keys, lambda x: _leaves(x, dtype.keyType))))
        if holds_text(dtype.valueType):
            parts.append(F.flatten(F.transform(values, lambda x: _leaves(x, dtype.valueType))))
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _nested(value: Column, dtype: T.DataType) -> Column:
    """A nested value with all its strings scrubbed."""
    if not holds_text(dtype):
        return value
    if isinstance(dtype, T.StringType):
        return scrubbed_text(value)["text"]
    if isinstance(dtype, T.StructType):
        made = F.struct(*[_nested(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: _nested(x, dtype.elementType))
    keys = F.transform_keys(value, lambda k, _: _nested(k, dtype.keyType))
    return F.transform_values(keys, lambda _, v: _nested(v, dtype.valueType))


def refuse_secrets(col: Column, name: str) -> Column:
    """The string, or an error at run time if it holds a secret: a redacted key would no longer identify its row."""
    refused = F.raise_error(F.lit(f"key column {name} holds a secret")).cast("string")
    return F.when(scrubbed_text(col)["hits"] > 0, refused).otherwise(col)


def scrub(df: DataFrame, cols: list[str], count_col: str | None = "redactions") -> DataFrame:
    """Replace secrets in the columns ``cols`` and count the replacements per row.

    Structs, arrays and maps are scrubbed at any depth; map keys that become equal make the job fail.

    Each shape is guarded by a plain substring test, so text without the tell-tale characters never reaches the
    regular expressions. One projection per shape keeps every stage referenced by name instead of copied.
    """
    total = F.lit(0)
    out = df
    if count_col:
        out = out.withColumn(count_col, total)
    for name in cols:
        dtype = df.schema[name].dataType
        if not isinstance(dtype, T.StringType):
            if not holds_text(dtype):
                continue
            col = F.col(f"`{name}`")
            hits = F.aggregate(_leaves(col, dtype), F.lit(0), lambda n, leaf: n + F.coalesce(scrubbed_text(leaf)["hits"], F.lit(0)))
            counted = {count_col: F.col(count_col) + hits} if count_col else {}
            out = out.withColumns({name: _nested(col, dtype), **counted})
            continue
        for shape in SHAPES:
            col = F.col(f"`{name}`")
            present = _present(col, shape)
            changes = {
                name: F.when(present, F.regexp_replace(col, shape.pattern, shape.replacement)).otherwise(col)
            }
            if count_col:
                hits = F.when(present, F.regexp_count(col, F.lit(shape.pattern))).otherwise(F.lit(0))
                changes[count_col] = F.col(count_col) + hits
            out = out.withColumns(changes)
    return out


def string_columns(df: DataFrame, without: list[str] = ()) -> list[str]:
    """Names of the plain string columns."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in without]


def text_columns(df: DataFrame, without: list[str] = ()) -> list[str]:
    """Names of the columns that hold strings at any depth."""
    return [f.name for f in df.schema.fields if holds_text(f.dataType) and f.name not in without]
