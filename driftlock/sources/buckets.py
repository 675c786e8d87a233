"""Tables in folders by a hash of their keys, so that a reader opens only the folders of the keys it has."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock.functions.canonical import comparable, has_map

BUCKET = "__bucket"
# Rows of a folder on average, folders at least (a small table in one folder couldn't be pruned) and at most (each is
# listed once by a reader).
BUCKET_ROWS = 250_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
# Files of a folder, written by as many tasks: a key that many rows share would else go through one.
FILES = 4


def bucket_of(df: DataFrame, keys: list[str], buckets: int) -> Column:
    """The folder of a row. Keys that compare as equal have one folder; null is a value."""
    return F.pmod(F.xxhash64(*[comparable(F.col(f"`{k}`"), df.schema[k].dataType) for k in keys]), F.lit(buckets)).cast("int")


def bucket_count(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, ceil(rows / bucket_rows)))


@dataclass(frozen=True)
class BucketedTable:
    """A stored table and how its rows are dealt to folders."""

    path: str
    keys: tuple[str, ...]
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, with their folder as the column ``BUCKET``."""
        return spark.read.parquet(self.path)

    def wanted(self, df: DataFrame) -> list[int]:
        """The folders in which the keys of ``df`` may be: a list no longer than there are folders."""
        rows = df.select(bucket_of(df, list(self.keys), self.buckets).alias("b")).distinct().collect()
        return sorted(r[0] for r in rows)

    def part(self, whole: DataFrame, df: DataFrame) -> DataFrame:
        """The rows of ``whole``, what ``read`` gave, that may share a key with ``df``. Other folders are not opened."""
        return whole.where(F.col(BUCKET).isin(self.wanted(df))).drop(BUCKET)


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int | None = None, files: int = FILES) -> BucketedTable:
    """Store the rows by a hash of their keys. One shuffle; a key with many rows goes through ``files`` tasks."""
    if buckets is None:
        buckets = bucket_count(df.count())
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not has_map(df.schema[c].dataType)]), F.lit(files))
    dealt = df.withColumn(BUCKET, bucket_of(df, keys, buckets))
    # As many tasks as folders at most, each with whole (folder, file) pairs.
    dealt.repartition(buckets, BUCKET, spread).write.partitionBy(BUCKET).parquet(path)
    return BucketedTable(path, tuple(keys), buckets)

