"""Values in a form that can be compared, grouped, hashed and printed the same way on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_map(dtype: T.DataType) -> bool:
    """Whether a map occurs anywhere inside the type."""
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(has_map(f.dataType) for f in dtype.fields)
    return False


def comparable(col: Column, dtype: T.DataType) -> Column:
    """Maps become arrays of entries sorted by key, at any depth; everything else stays native."""
    if not has_map(dtype):
        return col
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.struct(
                comparable(e["key"], dtype.keyType).alias("key"),
                comparable(e["value"], dtype.valueType).alias("value"),
            ),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: comparable(x, dtype.elementType))
    fields = [comparable(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(col.isNotNull(), F.struct(*fields))


def comparable_columns(df: DataFrame, cols: list[str]) -> list[Column]:
    """The named columns of ``df`` in comparable form, under their own names."""
    return [comparable(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in cols]


def as_text(col: Column, dtype: T.DataType) -> Column:
    """Printable form: plain text for atomic values, JSON for nested ones. Never used to decide equality."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(comparable(col, dtype))
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def stable_bucket(parts: list[Column], buckets: int) -> Column:
    """A bucket in [0, buckets) that depends on the values only, never on partitioning.

    md5 rather than xxhash64 so that any SQL engine can reproduce the choice.
    """
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def stable_fraction(parts: list[Column]) -> Column:
    """A number in [0, 1) that depends on the values only."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").cast("double") / F.lit(float(2**48))
