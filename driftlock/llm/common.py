"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock.session import scratch_path

# The white space of all contracts here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; no other letter changes."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a text without words."""
    bare = strip_space(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, kept when executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected links: (id, component), the component being the smallest id reached.

    Each round joins the links with the labels, takes the smallest label among a node's neighbours, and then jumps
    to the label of that label, so chains shorten by half. Every round is written to the shared folder; the loop
    ends with the first round that changes no label.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id <> other")
    both = stored(both.union(both.select(F.col("other"), F.col("id"))).distinct(), "links")
    labels = stored(
        both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels"
    )
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("other"), "component"), "other")
            .groupBy("id")
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid")
        )
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        after = lowered.join(jump, "mid", "left").select(
            "id", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")
        )
        after = stored(after, "labels")
        labels = after.select("id", "component")
        if after.where("component <> old").isEmpty():
            return labels


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column: those whose value stands alone go. One row is held back between batches."""
    held, out = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        key = batch.column(0).to_numpy()
        same = np.r_[False, key[1:] == key[:-1]]
        keep = same | np.r_[same[1:], False]
        if held is not None and out:
            keep[0] = False
        yield batch.filter(pa.array(keep))
        held, out = batch.slice(batch.num_rows - 1), bool(keep[-1])
