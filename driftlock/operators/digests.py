"""AG11 for parts of a table: digests per key range, as a tree, and a verification that looks only into ranges that differ.

A range is a prefix of the hash of the key, so ranges are of equal size whatever the keys are, and those of one more hex
digit divide it into sixteen. A digest holds the number of rows and two sums over 60 bits each of every row's hash; sums of
ranges add up to that of the range above, so one table of the finest ranges is the whole tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlock.functions.canonical import as_text
from driftlock.operators.verify import locked_columns, verify

RANGE = "__range"
# Hex digits of a finest range: 16 ** 3 = 4,096 of them.
DEPTH = 3
# Hex digits of each half of a row's hash that is summed; as many as fit a long.
_HALF = 15
_SUMS = ("n_rows", "sum_high", "sum_low")


def framed(df: DataFrame, cols: list[str]) -> Column:
    """The values of a row as one text that no other values have: each with its length, null as a dash."""
    parts = []
    for c in cols:
        text = as_text(F.col(f"`{c}`"), df.schema[c].dataType)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def range_of(df: DataFrame, keys: list[str], depth: int = DEPTH) -> Column:
    """The finest range of a row's key."""
    return F.substring(F.md5(framed(df, keys)), 1, depth)


def range_digests(df: DataFrame, keys: list[str], cols: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """AG11: ``(range, n_rows, sum_high, sum_low)`` for every range that has rows.

    One scan; tasks send one row per range. Equal rows count each.
    """
    cols = [c for c in (cols or df.columns) if c not in keys]
    hashed = df.select(range_of(df, keys, depth).alias("range"), F.md5(framed(df, [*keys, *cols])).alias("h"))

    def half(first: int) -> Column:
        return F.sum(F.conv(F.substring("h", first, _HALF), 16, 10).cast("decimal(38,0)"))

    return hashed.groupBy("range").agg(F.count("*").alias("n_rows"), half(1).alias("sum_high"), half(1 + _HALF).alias("sum_low"))


def level(digests: DataFrame, digits: int) -> DataFrame:
    """The digests of a coarser level of the tree."""
    return digests.groupBy(F.substring("range", 1, digits).alias("range")).agg(*[F.sum(c).alias(c) for c in _SUMS])


def differing_ranges(old: DataFrame, new: DataFrame, depth: int = DEPTH) -> list[str]:
    """The finest ranges whose digests differ, found from the root down.

    A level compares only the sixteen parts of each range that differs above it, so few differences read few rows of the
    digest tables; at most there are as many as there are finest ranges.
    """
    found = [""]
    for digits in range(1, depth + 1):
        within = F.substring("range", 1, digits - 1).isin(found) if digits > 1 else F.lit(True)
        sides = [level(side.where(within), digits).withColumn("side", F.lit(i)) for i, side in enumerate((old, new))]
        same = reduce(lambda a, b: a & b, [F.min(c) == F.max(c) for c in _SUMS], F.count("*") == 2)
        told = sides[0].unionByName(sides[1]).groupBy("range").agg(same.alias("same"))
        found = sorted(r["range"] for r in told.where("not same").collect())
        if not found:
            return []
    return found


@dataclass(frozen=True)
class RangedTable:
    """A stored table in folders by range, with its digests."""

    path: str
    keys: tuple[str, ...]
    depth: int

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows, with their range as text: ranges of digits alone would else be read as numbers."""
        kinds = spark.read.parquet(f"{self.path}/rows").schema.fields
        schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == RANGE else f for f in kinds])
        return spark.read.schema(schema).parquet(f"{self.path}/rows")

    def digests(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/digests")


def write_ranges(df: DataFrame, path: str, keys: list[str], depth: int = DEPTH) -> RangedTable:
    """Store a table in folders by range, and the digests of what was written."""
    spark = df.sparkSession
    dealt = df.withColumn(RANGE, range_of(df, keys, depth))
    dealt.repartition(RANGE).write.partitionBy(RANGE).parquet(f"{path}/rows")
    table = RangedTable(path, tuple(keys), depth)
    range_digests(table.rows(spark).drop(RANGE), keys, depth=depth).coalesce(1).write.parquet(f"{path}/digests")
    return table


def verify_ranges(
    baseline: DataFrame | RangedTable,
    current: DataFrame,
    keys: list[str] | None = None,
    cols: list[str] | None = None,
    depth: int = DEPTH,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """JN7 with a look at the digests first: ``(verdicts of the rows in ranges that differ, (range, n_rows, same))``.

    Ranges with equal digests are not joined, and of a stored baseline their folders are not opened: their rows are the
    same unless 120 bits of sums agree by chance, which no change makes likely. Where that is not proof enough, use
    ``verify``. ``n_rows`` counts the baseline's rows. ``cols`` are compared, by default all; options are those of ``verify``.
    """
    spark = current.sparkSession
    if isinstance(baseline, RangedTable):
        keys, depth = list(baseline.keys), baseline.depth
        old = baseline.rows(spark)
        plain = old.drop(RANGE)
        old_range = F.col(RANGE)
        old_digests = baseline.digests(spark) if cols is None else range_digests(plain, keys, cols, depth)
    else:
        old = plain = baseline
        old_range, old_digests = range_of(baseline, keys, depth), range_digests(baseline, keys, cols, depth)
    cols = locked_columns(plain, current, keys, cols)
    found = differing_ranges(old_digests, range_digests(current.select(*keys, *cols), keys, cols, depth), depth)
    inside_old = old.where(old_range.isin(found)).select(*keys, *cols)
    inside_new = current.where(range_of(current, keys, depth).isin(found))
    verdicts = verify(inside_old, inside_new, keys, cols, **options)
    return verdicts, old_digests.select("range", "n_rows", (~F.col("range").isin(found)).alias("same"))

