"""LK13, LK14: inject changes into a table and see which ones a baseline would catch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlock.functions.canonical import comparable_columns, stable_bucket

KINDS = ["null_out", "off_by_one", "sign_flip", "boundary_swap", "row_drop", "row_duplicate"]


@dataclass(frozen=True)
class Mutation:
    """One injected change. ``file`` is the group it is scored under; row changes need no column."""

    mutant_id: str
    kind: str
    column: str | None = None
    boundary: float | str | None = None
    file: str = "table"


def mutations_for(df: DataFrame, keys: list[str], boundaries: dict[str, list] | None = None, file: str = "table") -> list[Mutation]:
    """Every change that makes sense for the columns of a table, in column order, then the row changes."""
    out: list[Mutation] = []

    def add(kind: str, column: str | None = None, boundary=None) -> None:
        out.append(Mutation(f"{file}-{len(out):03d}", kind, column, boundary, file))

    for f in df.schema.fields:
        if f.name in keys:
            continue
        add("null_out", f.name)
        if isinstance(f.dataType, T.NumericType):
            add("off_by_one", f.name)
            add("sign_flip", f.name)
        for b in (boundaries or {}).get(f.name, []):
            add("boundary_swap", f.name, b)
    add("row_drop")
    add("row_duplicate")
    return out


def _mutated(col: Column, dtype: T.DataType, m: Mutation) -> Column:
    if m.kind == "null_out":
        return F.lit(None).cast(dtype)
    if m.kind == "boundary_swap":
        return F.lit(m.boundary).cast(dtype)
    if not isinstance(dtype, T.NumericType):
        raise ValueError(f"{m.kind} needs a numeric column, {m.column} is {dtype.simpleString()}")
    # try_ arithmetic: the extreme value of a type mutates to null instead of failing the job.
    if m.kind == "off_by_one":
        return F.try_add(col, F.lit(1).cast(dtype)).cast(dtype)
    return F.try_subtract(F.lit(0).cast(dtype), col).cast(dtype)


def mutate(df: DataFrame, keys: list[str], mutations: list[Mutation], share: float = 0.5) -> DataFrame:
    """LK13: affected rows before (``weight`` -1) and after (+1) each change, with the ``mutant_id``.

    A hash of the key assigns each row to one change or to none, so about ``share`` of the rows take part and
    every change gets an equal part of them. One narrow pass: no join, and the choice does not depend on
    partitioning.
    """
    unknown = [m.kind for m in mutations if m.kind not in KINDS]
    if unknown:
        raise ValueError(f"unknown kinds {unknown}")
    buckets = max(len(mutations), round(len(mutations) / share))
    slot = stable_bucket([F.col(f"`{k}`") for k in keys], buckets)
    chosen = df.withColumn("__slot", slot).where(F.col("__slot") < len(mutations))

    after = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        new = col
        for i, m in enumerate(mutations):
            if m.column == f.name:
                new = F.when(F.col("__slot") == i, _mutated(col, f.dataType, m)).otherwise(new)
        after.append(new.alias(f.name))
    copies = F.lit(1)
    for i, m in enumerate(mutations):
        if m.kind in ("row_drop", "row_duplicate"):
            copies = F.when(F.col("__slot") == i, 0 if m.kind == "row_drop" else 2).otherwise(copies)
    before = F.struct(F.lit(-1).alias("weight"), *[F.col(f"`{c}`") for c in df.columns])
    changed = F.struct(F.lit(1).alias("weight"), *after)
    ids = F.array(*[F.lit(m.mutant_id) for m in mutations])
    return chosen.select(
        F.element_at(ids, F.col("__slot") + 1).alias("mutant_id"),
        F.explode(F.concat(F.array(before), F.array_repeat(changed, copies))).alias("r"),
    ).select("mutant_id", "r.*")


def prove(mutated: DataFrame, keys: list[str], mutations: list[Mutation], locked_cols: list[str]) -> DataFrame:
    """LK14: ``(mutant_id, kind, file, status)``, ready for ``mutation_scores``.

    A change is killed when some key's locked values differ as a bag before and after it, has no coverage when
    its column is outside the lock or it met no row, and survives otherwise.
    """
    locked = [c for c in locked_cols if c not in keys]
    by = comparable_columns(mutated, [*keys, *locked])
    net = mutated.groupBy("mutant_id", *by).agg(F.sum("weight").alias("net"))
    seen = net.groupBy("mutant_id").agg(F.max(F.col("net") != 0).alias("caught"))
    spark = mutated.sparkSession
    all_mutants = spark.createDataFrame(
        [(m.mutant_id, m.kind, m.file, m.column is None or m.column in locked) for m in mutations],
        "mutant_id string, kind string, file string, locked boolean",
    )
    status = (
        F.when(~F.col("locked") | F.col("caught").isNull(), "NoCoverage")
        .when(F.col("caught"), "Killed")
        .otherwise("Survived")
    )
    return all_mutants.join(seen, "mutant_id", "left").select("mutant_id", "kind", "file", status.alias("status"))
