"""Baseline against current: verdicts, gate, cell deltas, bag differences, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftlock.functions.bind import picked
from driftlock.functions.canonical import as_text, comparable, comparable_columns

IDENTICAL, CHANGED, MISSING, ADDED = "identical", "changed", "missing", "added"
DUPLICATE_MESSAGE = "several rows for one key"


class SchemaBreak(Exception):
    """The current output cannot be judged: a locked column is gone or has another type."""


class DuplicateKeys(Exception):
    """The keys do not identify a row, so rows cannot be paired."""


# --- LK9 ------------------------------------------------------------------------------------------------------


def schema_break(baseline_schema: T.StructType, current: DataFrame | T.StructType) -> list[str]:
    """LK9: locked columns that are missing or changed type; empty when the behaviour can be judged."""
    now = current.schema if isinstance(current, DataFrame) else current
    types = {f.name: f.dataType.simpleString() for f in now.fields}
    errors = []
    for field in baseline_schema.fields:
        was = field.dataType.simpleString()
        if field.name not in types:
            errors.append(f"error: locked column '{field.name}' is missing")
        elif types[field.name] != was:
            errors.append(f"error: locked column '{field.name}' changed type from {was} to {types[field.name]}")
    return list(dict.fromkeys(errors))


# --- JN7 ------------------------------------------------------------------------------------------------------


def locked_columns(baseline: DataFrame, current: DataFrame, keys: list[str], cols: list[str] | None) -> list[str]:
    cols = [c for c in (cols or baseline.columns) if c not in keys]
    locked = T.StructType([baseline.schema[c] for c in [*keys, *cols]])
    errors = schema_break(locked, current)
    if errors:
        raise SchemaBreak("; ".join(errors))
    return cols


def _repeated(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat on either side, found in one job over the key columns of both."""
    return (
        _net_counts(baseline, current, keys)
        .where((F.col("n_old") > 1) | (F.col("n_new") > 1))
        .withColumnsRenamed({"n_old": "rows_in_baseline", "n_new": "rows_in_current"})
    )


def _differs(old: Column, new: Column, tolerance: float | None) -> Column:
    differs = ~old.eqNullSafe(new)
    if tolerance is not None:
        close = F.coalesce(F.abs(old - new) <= F.lit(tolerance), F.lit(False))
        differs = differs & ~close
    return differs


def _filler(dtype: T.DataType) -> Column | None:
    """A value to stand in for null in a join column, or nothing if the type has no simple one."""
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(dtype)
    return None


def _bit(i: int | None) -> Column:
    return F.lit(0 if i is None else 2**i).cast("bigint")


def _key(mark: str, i: int, dtype: T.DataType) -> Column:
    """The i-th key of a side, null where its bit says so."""
    value = F.col(f"__{mark}j{i}")
    if _filler(dtype) is None:
        return value
    return F.when(F.col(f"__{mark}nulls").bitwiseAND(_bit(i)) == 0, value)


def _side(df: DataFrame, mark: str, keys: list[str], cols: list[str], prefix: str, guard: bool) -> DataFrame:
    """One side of a pairing: join columns, values, and the presence mark.

    Which keys are null is one number and the keys themselves are filled: plain equality on these columns is
    null-safe, they serve the guard as well as the join, and ``_key`` restores the keys from them.
    """
    key_cols = [comparable(F.col(f"`{k}`"), df.schema[k].dataType) for k in keys]
    fillers = [_filler(df.schema[k].dataType) for k in keys]
    nulls = reduce(
        lambda x, y: x + y,
        [
            F.when(c.isNull(), _bit(i)).otherwise(_bit(None))
            for i, (c, f) in enumerate(zip(key_cols, fillers))
            if f is not None
        ],
        _bit(None),
    )
    out = df.select(
        *[
            (c if f is None else F.coalesce(c, f)).alias(f"__{mark}j{i}")
            for i, (c, f) in enumerate(zip(key_cols, fillers))
        ],
        nulls.alias(f"__{mark}nulls"),
        *[comparable(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"{prefix}_{c}") for c in cols],
        F.lit(True).alias(f"__{mark}"),
    )
    if not guard:
        return out
    joined_on = [f"__{mark}j{i}" for i in range(len(keys))] + [f"__{mark}nulls"]
    repeat = F.row_number().over(Window.partitionBy(*joined_on).orderBy(joined_on[0]))
    side = "baseline" if prefix == "old" else "current"
    shown = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in joined_on[:-1]])
    refuse = F.raise_error(F.concat(F.lit(f"{DUPLICATE_MESSAGE} in {side}: "), shown)).cast("boolean")
    return out.withColumn("__repeat", repeat).withColumn(
        f"__{mark}", F.when(F.col("__repeat") == 1, F.col(f"__{mark}")).otherwise(refuse)
    )


def paired(
    baseline: DataFrame,
    current: DataFrame,
    keys: list[str],
    cols: list[str],
    how: str = "full",
    guard: bool = False,
    guard_new: bool | None = None,
) -> DataFrame:
    """Rows of both sides next to each other: the keys, ``old_<col>``, ``new_<col>``, ``in_old``, ``in_new``.

    Keys are compared null-safe. Both sides are shuffled once on the keys; the verdict, the cell delta and the
    acceptance are all projections of this one join. ``guard`` makes the job fail on the second row of a key: a
    row number over the shuffle and sort that the join needs anyway. It is part of the join condition, so a count of
    the result runs it too for all keys that meet. ``guard_new`` sets it apart for the current side, where a stream may repeat keys.
    """
    old = _side(baseline, "o", keys, cols, "old", guard)
    new = _side(current, "n", keys, cols, "new", guard if guard_new is None else guard_new)
    same = [
        old[f"__oj{i}"] == new[f"__nj{i}"]
        if _filler(baseline.schema[k].dataType) is not None
        else old[f"__oj{i}"].eqNullSafe(new[f"__nj{i}"])
        for i, k in enumerate(keys)
    ]
    same_key = reduce(lambda a, b: a & b, [*same, old["__onulls"] == new["__nnulls"]])
    in_old, in_new = F.col("__o").isNotNull(), F.col("__n").isNotNull()
    if guard:
        same_key = same_key & old["__o"] & new["__n"]
    return old.join(new, same_key, how).select(
        *[
            F.when(in_old, _key("o", i, baseline.schema[k].dataType))
            .otherwise(_key("n", i, current.schema[k].dataType))
            .alias(k)
            for i, k in enumerate(keys)
        ],
        *[F.col(f"`old_{c}`") for c in cols],
        *[F.col(f"`new_{c}`") for c in cols],
        in_old.alias("in_old"),
        in_new.alias("in_new"),
    )


def _differences(cols: list[str], tolerance: dict[str, float] | None) -> list[tuple[Column, str]]:
    tolerance = tolerance or {}
    return [(_differs(F.col(f"`old_{c}`"), F.col(f"`new_{c}`"), tolerance.get(c)), c) for c in cols]


def is_changed(cols: list[str], tolerance: dict[str, float] | None = None) -> Column:
    """Whether any column of a paired row differs."""
    return reduce(lambda a, b: a | b, [d for d, _ in _differences(cols, tolerance)], F.lit(False))


def changed_columns(cols: list[str], tolerance: dict[str, float] | None = None) -> Column:
    """Names of the columns of a paired row whose values differ."""
    return picked(_differences(cols, tolerance))


def verify(
    baseline: DataFrame,
    current: DataFrame,
    keys: list[str],
    cols: list[str] | None = None,
    tolerance: dict[str, float] | None = None,
    on_duplicates: str = "guard",
    reference_statuses: bool = False,
) -> DataFrame:
    """JN7: one verdict per key, ``(keys…, status, changed_cols)``.

    ``on_duplicates`` says what to do when the keys repeat: ``guard`` fails the job that computes the verdicts, at
    no extra shuffle; ``fail`` counts the keys in a job of its own and raises before anything else runs; ``bag``
    compares the rows of each key as a bag (see ``verify_bag``). ``reference_statuses`` reports a vanished row as
    identical and ignores rows without a baseline.
    """
    if on_duplicates not in ("guard", "fail", "bag"):
        raise ValueError(f"on_duplicates: {on_duplicates!r}")
    if on_duplicates == "bag":
        if tolerance:
            raise ValueError("a tolerance needs unique keys")
        verdicts = verify_bag(baseline, current, keys, cols).drop("n_old", "n_new")
    else:
        cols = locked_columns(baseline, current, keys, cols)
        if on_duplicates == "fail":
            examples = _repeated(baseline, current, keys).limit(5).collect()
            if examples:
                raise DuplicateKeys(f"{DUPLICATE_MESSAGE}, for example {[r.asDict() for r in examples]}")
        changed = F.col("in_old") & F.col("in_new") & is_changed(cols, tolerance)
        # The names are put together for changed rows only; most rows stop at the comparison.
        verdicts = paired(baseline, current, keys, cols, guard=on_duplicates == "guard").select(
            *[F.col(f"`{k}`") for k in keys],
            F.when(~F.col("in_new"), MISSING)
            .when(~F.col("in_old"), ADDED)
            .when(changed, CHANGED)
            .otherwise(IDENTICAL)
            .alias("status"),
            F.when(changed, changed_columns(cols, tolerance))
            .otherwise(F.array().cast("array<string>"))
            .alias("changed_cols"),
        )
    if reference_statuses:
        verdicts = verdicts.where(F.col("status") != ADDED).withColumn(
            "status", F.when(F.col("status") == MISSING, IDENTICAL).otherwise(F.col("status"))
        )
    return verdicts


def verify_bag(
    baseline: DataFrame, current: DataFrame, keys: list[str], cols: list[str] | None = None
) -> DataFrame:
    """JN7 for keys that repeat: the rows of a key are compared as a bag, exactly.

    Equal rows cancel in a first aggregation over whole rows, which also collapses copies before the shuffle, so
    a key that owns a large share of the table never meets in one task. Only what did not cancel keeps its
    values for the second aggregation. ``changed_cols`` is filled when a key has one row on each side.
    """
    cols = locked_columns(baseline, current, keys, cols)
    net = _net_counts(baseline, current, [*keys, *cols])
    left_over = F.col("n_old") != F.col("n_new")
    aggregates = [
        F.sum("n_old").alias("n_old"),
        F.sum("n_new").alias("n_new"),
        F.max(left_over).alias("differs"),
    ]
    for i, c in enumerate(cols):
        value = F.when(left_over, F.col(f"`{c}`"))
        aggregates += [
            F.count(value).alias(f"__c{i}"),
            F.min(value).alias(f"__min{i}"),
            F.max(value).alias(f"__max{i}"),
        ]
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1) & F.col("differs")
    changed = picked(
        [
            ((F.col(f"__c{i}") == 1) | ((F.col(f"__c{i}") == 2) & (F.col(f"__min{i}") != F.col(f"__max{i}"))), c)
            for i, c in enumerate(cols)
        ]
    )
    none = F.array().cast("array<string>")
    return (
        net.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(*aggregates)
        .select(
            *[F.col(f"`{k}`") for k in keys],
            F.when(F.col("n_new") == 0, MISSING)
            .when(F.col("n_old") == 0, ADDED)
            .when(F.col("differs"), CHANGED)
            .otherwise(IDENTICAL)
            .alias("status"),
            F.when(single, changed).otherwise(none).alias("changed_cols"),
            "n_old",
            "n_new",
        )
    )


def verify_summary(verdicts: DataFrame, broke: bool = False, in_scope: bool = True) -> DataFrame:
    """AG6: totals and the gate. An empty suite is a failure; nothing in scope is a pass."""
    gate = F.lit(1) if broke else F.when(F.col("preserved"), 0).otherwise(1)
    if not in_scope:
        gate = F.lit(0)
    return (
        verdicts.agg(
            F.count("*").alias("total"),
            F.count_if(F.col("status") == CHANGED).alias("changed"),
            F.count_if(F.col("status") == IDENTICAL).alias("identical"),
            F.count_if(F.col("status") == MISSING).alias("missing"),
            F.count_if(F.col("status") == ADDED).alias("added"),
        )
        .withColumn(
            "preserved", F.lit(not broke) & (F.col("total") > 0) & (F.col("identical") == F.col("total"))
        )
        .withColumn("gate_code", gate.cast("int"))
    )


# --- LK6 ------------------------------------------------------------------------------------------------------


def cell_delta(
    baseline: DataFrame,
    current: DataFrame,
    keys: list[str],
    cols: list[str] | None = None,
    tolerance: dict[str, float] | None = None,
) -> DataFrame:
    """LK6: ``(keys…, column, old, new)`` for every changed cell of rows present on both sides.

    One join; values turn into text only for cells that changed. Keys that repeat make the job fail.
    """
    cols = locked_columns(baseline, current, keys, cols)
    tolerance = tolerance or {}
    cells = []
    for c in cols:
        dtype = baseline.schema[c].dataType
        old, new = F.col(f"`old_{c}`"), F.col(f"`new_{c}`")
        cells.append(
            F.when(
                _differs(old, new, tolerance.get(c)),
                F.struct(
                    F.lit(c).alias("column"), as_text(old, dtype).alias("old"), as_text(new, dtype).alias("new")
                ),
            )
        )
    rows = paired(baseline, current, keys, cols, how="inner", guard=True).where(is_changed(cols, tolerance))
    return rows.select(
        *[F.col(f"`{k}`") for k in keys], F.explode(F.array_compact(F.array(*cells))).alias("cell")
    ).select(*[F.col(f"`{k}`") for k in keys], "cell.column", "cell.old", "cell.new")


def cell_counts(delta: DataFrame) -> DataFrame:
    """LK6: changed cells per column."""
    return delta.groupBy("column").agg(F.count("*").alias("n_changed"))


# --- SET2, AG11 -----------------------------------------------------------------------------------------------


def _net_counts(baseline: DataFrame, current: DataFrame, cols: list[str]) -> DataFrame:
    old = baseline.select(
        *comparable_columns(baseline, cols), F.lit(1).alias("__old"), F.lit(0).alias("__new")
    )
    new = current.select(*comparable_columns(current, cols), F.lit(0).alias("__old"), F.lit(1).alias("__new"))
    return (
        old.unionByName(new)
        .groupBy(*[F.col(f"`{c}`") for c in cols])
        .agg(F.sum("__old").alias("n_old"), F.sum("__new").alias("n_new"))
    )


def bag_diff(baseline: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """SET2: rows that occur more often on one side, with ``side`` (``-`` baseline, ``+`` current) and ``n``.

    One aggregation instead of two multiset differences: each side is read and shuffled once.
    """
    cols = cols or baseline.columns
    surplus = F.col("n_new") - F.col("n_old")
    return (
        _net_counts(baseline, current, cols)
        .where("n_old <> n_new")
        .select(
            *[F.col(f"`{c}`") for c in cols],
            F.when(surplus < 0, "-").otherwise("+").alias("side"),
            F.abs(surplus).alias("n"),
        )
    )


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AG11: order-free digest of a table: row count, xor and sum of row hashes.

    Different digests prove a change; equal digests are a cheap hint, never a proof.
    """
    cols = cols or df.columns
    hashed = df.select(F.xxhash64(*comparable_columns(df, cols)).alias("h"))
    return hashed.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )
