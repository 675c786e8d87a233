"""Mutation scores, coverage totals, outcome profile, usage cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlock import vocab
from driftlock.functions.names import base_name

# --- AG4 ------------------------------------------------------------------------------------------------------

_STATUSES = {"killed": "Killed", "survived": "Survived", "no_coverage": "NoCoverage", "timeout": "Timeout"}


def mutation_scores(mutants: DataFrame) -> DataFrame:
    """AG4: counts and score per file, and overall as the row whose ``file`` is null.

    Statuses other than the four are ignored, and files left without any are omitted. The roll-up runs over the
    counts per file, not over the mutants. A report lists the overall row first, then files by the number tested.
    """
    counts = [F.count_if(F.col("status") == s).alias(n) for n, s in _STATUSES.items()]
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _STATUSES]
    tested = F.expr(" + ".join(_STATUSES))
    caught = (F.col("killed") + F.col("timeout")).cast("double")
    return (
        mutants.groupBy("file")
        .agg(*counts)
        .rollup("file")
        .agg(*sums, F.grouping("file").alias("overall"))
        .withColumn("tested", tested)
        .where((F.col("tested") > 0) | (F.col("overall") == 1))
        .withColumn("score", F.when(F.col("tested") == 0, 0.0).otherwise(100.0 * caught / F.col("tested")))
        .select("file", *_STATUSES, "tested", "score", (F.col("overall") == 1).alias("is_overall"))
    )


# --- AG5 ------------------------------------------------------------------------------------------------------


def coverage_totals(coverage: DataFrame, by: list[str] = ()) -> DataFrame:
    """AG5: summed line and branch counts with their rates, overall or by group; a rate is 0 when its total is 0."""
    names = ["lines_covered", "lines_valid", "branches_covered", "branches_valid"]
    sums = coverage.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    return sums.withColumns(
        {
            "line_rate": F.coalesce(F.try_divide("lines_covered", "lines_valid"), F.lit(0.0)),
            "branch_rate": F.coalesce(F.try_divide("branches_covered", "branches_valid"), F.lit(0.0)),
        }
    )


# --- AG10 -----------------------------------------------------------------------------------------------------


def outcome_profile(entries: DataFrame) -> DataFrame:
    """AG10: entries per kind of outcome (an error type, or ``value``) and their share of all entries.

    The share is a window over the grouped table, which has one row per error type.
    """
    kind = F.when(F.col("is_error"), F.regexp_extract("outcome", r"^(\w+): ", 1)).otherwise("value")
    grouped = entries.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return grouped.select("kind", "n", (F.col("n") / total).alias("share"))


# --- JN11, AG8 ------------------------------------------------------------------------------------------------


def model_rate(model: Column, rates: list[tuple[str, int, int]] = vocab.MODEL_RATES) -> tuple[Column, Column]:
    """JN11: input and output rate of a model; the first needle its name contains decides."""
    low = F.lower(model)
    rate_in = rate_out = None
    for needle, per_in, per_out in reversed(rates):
        i, o = F.lit(per_in).cast("decimal(10,2)"), F.lit(per_out).cast("decimal(10,2)")
        hit = F.coalesce(F.contains(low, F.lit(needle)), F.lit(False))
        rate_in = i if rate_in is None else F.when(hit, i).otherwise(rate_in)
        rate_out = o if rate_out is None else F.when(hit, o).otherwise(rate_out)
    return rate_in, rate_out


def price_usage(usage: DataFrame, rates: list[tuple[str, int, int]] = vocab.MODEL_RATES) -> DataFrame:
    """JN11: add ``cost_usd`` in exact decimal arithmetic."""
    rate_in, rate_out = model_rate(F.col("model"), rates)

    def tokens(name: str) -> Column:
        return F.col(name).cast("decimal(14,0)")

    billable = (
        tokens("input_tokens")
        + tokens("cache_creation_tokens") * F.lit(vocab.CACHE_WRITE_FACTOR).cast("decimal(4,2)")
        + tokens("cache_read_tokens") * F.lit(vocab.CACHE_READ_FACTOR).cast("decimal(4,2)")
    )
    per_million = billable * rate_in + tokens("output_tokens") * rate_out
    # Four fractional digits before, six more from the division: ten digits hold the cost exactly.
    cost = per_million.cast("decimal(24,4)") * F.lit("0.000001").cast("decimal(7,6)")
    return usage.withColumn("cost_usd", cost.cast("decimal(28,10)"))


def usage_totals(priced: DataFrame) -> DataFrame:
    """AG8: calls, tokens and cost in one row."""
    return priced.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cache_read_tokens"), F.lit(0)).alias("cache_read_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0).cast("decimal(28,10)")).cast("decimal(38,10)").alias("cost_usd"),
    )


def normalized_file(path: Column) -> Column:
    """File name after turning backslashes, used as the key of score tables."""
    return base_name(F.replace(path, F.lit("\\"), F.lit("/")))
