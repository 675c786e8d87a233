"""From raw documents to packed sequences: five stages, each one operator of ``driftlock.llm``.

Every stage takes what its predecessor kept and returns documents with the same columns; the last returns the pieces of
packed sequences. ``run`` writes each result as Parquet to the shared folder and reads it again, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock.llm import decontam, jaccard, line_dedup, packing, quality
from driftlock.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go. A null text has no words and goes."""
    return quality.keep(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay only in the document with the largest id."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    Documents without words are linked with nothing and stay. Rows that share the smallest id stay together.
    """
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    inner = docs.select(F.struct("*").alias("__doc"), "text")
    return decontam.find_contamination(inner, items).where(~F.col("contaminated")).select("__doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_repeats", line_repeats),
    ("near_duplicates", near_duplicates),
    ("without_benchmark", without_benchmark),
    ("sequences", sequences),
]

# Token ids and the order of packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
