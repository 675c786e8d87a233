"""SRC4 to SRC8: mutation reports, coverage files, pattern lists, usage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlock.functions.text import trim_space
from driftlock.operators.scores import normalized_file

# --- SRC4 -----------------------------------------------------------------------------------------------------


def parse_mutants(reports: DataFrame, body: str = "value") -> DataFrame:
    """SRC4: ``mutants(file, status)`` from JSON reports, one report per row.

    Read as variants, so a file that is not an object or a list that is not an array is skipped instead of
    spoiling its report.
    """
    doc = F.try_parse_json(F.col(body))
    files = F.try_variant_get(doc, "$.files", "map<string, variant>")
    mutants = F.try_variant_get(F.col("entry"), "$.mutants", "array<variant>")
    return (
        reports.select(F.explode(files).alias("key", "entry"))
        .select("key", F.explode(mutants).alias("mutant"))
        .select(
            normalized_file(F.col("key")).alias("file"),
            F.try_variant_get(F.col("mutant"), "$.status", "string").alias("status"),
        )
    )


def read_mutants(spark: SparkSession, path: str) -> DataFrame:
    """SRC4 over files holding one JSON report each."""
    return parse_mutants(spark.read.text(path, wholetext=True))


# --- SRC5 -----------------------------------------------------------------------------------------------------

_ATTRIBUTES = ["lines-covered", "lines-valid", "branches-covered", "branches-valid"]
_COVERAGE_ROOT = ", ".join(f"`_{a}` string" for a in _ATTRIBUTES)


def _coverage_columns(root: str | None = None) -> list[Column]:
    """Attribute values as numbers; a missing or non-integer one counts 0."""
    out = []
    for a in _ATTRIBUTES:
        value = F.col(f"`_{a}`") if root is None else F.col(root)[f"_{a}"]
        out.append(F.coalesce(F.trim(value).try_cast("int"), F.lit(0)).cast("bigint").alias(a.replace("-", "_")))
    return out


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: one row per coverage file, from the attributes of its root element."""
    files = spark.read.format("xml").option("rowTag", "coverage").schema(_COVERAGE_ROOT).load(path)
    return files.select(*_coverage_columns())


def parse_coverage(reports: DataFrame, body: str = "value", keep: list[str] = ()) -> DataFrame:
    """SRC5 over a column of coverage documents; the columns in ``keep`` travel along."""
    parsed = reports.select(*keep, F.from_xml(F.col(body), F.lit(_COVERAGE_ROOT)).alias("root"))
    return parsed.select(*keep, *_coverage_columns("root"))


# --- SRC6 -----------------------------------------------------------------------------------------------------


# A line whose first visible character does not start a comment.
_PATTERN_LINE = r"^[\s\x{A0}]*[^\s\x{A0}#]"


def distinct_patterns(lines: DataFrame, line: str, order: list[Column]) -> DataFrame:
    """SRC6: trimmed lines without blanks and comments, distinct ignoring case, the first spelling kept."""
    kept = lines.where(F.col(line).rlike(_PATTERN_LINE)).select(
        trim_space(F.col(line)).alias("pattern"), F.struct(*order).alias("place")
    )
    return (
        kept.groupBy(F.lower("pattern").alias("key"))
        .agg(F.min(F.struct("place", "pattern")).alias("first"))
        .select("first.pattern")
    )


def load_patterns(spark: SparkSession, inline: list[str] = (), path: str | None = None) -> DataFrame:
    """SRC6: ``patterns(pattern)`` from inline values, split on commas, followed by the lines of a file.

    Inline values are never comments.
    """
    values = [p.strip() for text in inline for p in text.split(",") if p.strip()]
    given = spark.createDataFrame(
        [(0, "", i, p) for i, p in enumerate(values)], "source int, file string, place bigint, pattern string"
    )
    if path is not None:
        text = spark.read.text(path).where(F.col("value").rlike(_PATTERN_LINE)).select(
            F.lit(1).alias("source"),
            F.col("_metadata.file_path").alias("file"),
            F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("at"),
            trim_space(F.col("value")).alias("pattern"),
        )
        given = given.select(
            "source", "file", F.struct(F.lit(0).cast("bigint").alias("file_block_start"), F.col("place").alias("id")).alias("at"), "pattern"
        ).unionByName(text)
        order = ["source", "file", "at"]
    else:
        order = ["source", "file", "place"]
    return (
        given.groupBy(F.lower("pattern").alias("key"))
        .agg(F.min(F.struct(*order, "pattern")).alias("first"))
        .select("first.pattern")
    )


# --- SRC7 -----------------------------------------------------------------------------------------------------

_USAGE_BODY = """
    usage struct<
        input_tokens: bigint, output_tokens: bigint,
        cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint,
        prompt_tokens: bigint, completion_tokens: bigint,
        prompt_tokens_details: struct<cached_tokens: bigint>
    >
"""


def read_usage_log(df: DataFrame, body_col: str, provider_col: str, breakdown: str = "openai") -> DataFrame:
    """SRC7: add normalised token counts parsed from response bodies of two shapes.

    The ``breakdown`` provider reports cached tokens inside its prompt tokens, so they are taken out of the
    billed input; the other shape already reports four separate counts. Missing counts are 0.
    """
    u = F.from_json(F.col(body_col), _USAGE_BODY)["usage"]

    def count(value: Column) -> Column:
        return F.coalesce(value, F.lit(0).cast("bigint"))

    cached = count(u["prompt_tokens_details"]["cached_tokens"])
    inside = F.col(provider_col) == breakdown
    return df.withColumns(
        {
            "input_tokens": F.when(
                inside, F.greatest(F.lit(0).cast("bigint"), count(u["prompt_tokens"]) - cached)
            ).otherwise(count(u["input_tokens"])),
            "output_tokens": F.when(inside, count(u["completion_tokens"])).otherwise(count(u["output_tokens"])),
            "cache_read_tokens": F.when(inside, cached).otherwise(count(u["cache_read_input_tokens"])),
            "cache_creation_tokens": F.when(inside, F.lit(0).cast("bigint")).otherwise(
                count(u["cache_creation_input_tokens"])
            ),
        }
    )
