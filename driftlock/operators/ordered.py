"""Window operators that stay parallel when one group holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlock.session import cut_lineage

# Groups up to this many rows are handled by one plain window.
PLAIN_WINDOW_ROWS = 5_000_000


def prefix_sum(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    value: Column,
    name: str,
    plain_rows: int = PLAIN_WINDOW_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (the row itself excluded), 0 for the first row.

    ``order`` must be unique within a group. If every group fits one task a plain window does it. Otherwise the
    rows are range-partitioned by (group, order), so a large group spreads over many tasks; each slice is summed
    on its own and shifted by the total of the slices before it.
    """
    if group:
        largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
        if largest <= plain_rows:
            before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))

    keyed = [*[F.col(f"`{g}`") for g in group], *order]
    slices = cut_lineage(
        df.withColumn("__value", value)
        .repartitionByRange(*keyed)
        .sortWithinPartitions(*keyed)
        .withColumn("__slice", F.spark_partition_id())
    )
    totals = slices.groupBy(*group, "__slice").agg(F.sum("__value").alias("__total"))
    earlier_slices = (
        Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *group, "__slice", F.coalesce(F.sum("__total").over(earlier_slices), F.lit(0)).alias("__offset")
    )
    # Group columns may be null, and the pair (group, slice) is unique in the offsets.
    offsets = offsets.select(
        *[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)],
        F.col("__slice").alias("__s"),
        "__offset",
    )
    same = F.col("__slice") == F.col("__s")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    inside = (
        Window.partitionBy(*group, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = slices.withColumn("__local", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return local.join(offsets, same).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__local") + F.col("__offset")).alias(name)
    )


def first_by_id(df: DataFrame, ids: list[str], order: list[Column]) -> DataFrame:
    """WN1: of rows with the same id, the first one. Each task forwards at most one row per id."""
    return cap_per_group(df, ids, order, 1)


def cap_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """WN4: the first ``n`` rows of each group. The limit is applied before the shuffle as well as after it."""
    w = Window.partitionBy(*[F.col(f"`{g}`") for g in group]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def rank_hotspots(
    df: DataFrame, order: list[Column], partition: list[str] | None = None, name: str = "position"
) -> DataFrame:
    """WN3: 1-based position in report order, per partition or over the whole table.

    The order must end in a unique column. The global form never sorts the table in one task.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("bigint"))
    ranked = prefix_sum(df, [], order, F.lit(1).cast("bigint"), name)
    return ranked.withColumn(name, (F.col(name) + 1).cast("bigint"))


def occurrence_no(df: DataFrame, doc: list[str], line: str, pos: str, name: str = "occurrence") -> DataFrame:
    """WN5: number the repeats of a line inside its document, in order of position."""
    w = Window.partitionBy(*doc, line).orderBy(pos)
    return df.withColumn(name, F.row_number().over(w))


def spend_ceiling(
    usage: DataFrame, cap: float | str, run: list[str], order: list[Column], cost: str = "cost_usd"
) -> DataFrame:
    """WN2: a call is admitted while the cost of the earlier calls of its run is below the cap.

    The call that crosses the cap still runs; everything after it is refused.
    """
    spent = prefix_sum(usage, run, order, F.col(cost), "spent_before")
    return spent.withColumn("admitted", F.col("spent_before") < F.lit(str(cap)).cast("decimal(30,10)"))
