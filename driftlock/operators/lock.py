"""Recording behaviour: capture, flaky quarantine, batches, acceptance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlock import vocab
from driftlock.functions.bind import let
from driftlock.functions.canonical import as_text
from driftlock.functions.checked import Checked, CheckedRow
from driftlock.functions.scrub import scrub, string_columns, text_columns
from driftlock.operators.verify import IDENTICAL, is_changed, paired, schema_break, verify
from driftlock.session import cut_lineage

# --- LK1 ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ErrorRule:
    """An error the transform raises for a row, recorded as data: ``"<kind>: <message>"``."""

    condition: Column
    kind: str
    message: str | Column


def _display(df: DataFrame, cols: list[str]) -> Column:
    """``(a, b)`` with null spelled out."""
    texts = [F.coalesce(as_text(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("null")) for c in cols]
    return F.concat(F.lit("("), F.concat_ws(", ", *texts), F.lit(")"))


def capture(
    inputs: DataFrame,
    transform: Callable[[DataFrame], DataFrame] | None,
    unit_col: str,
    entry_col: str,
    input_cols: list[str],
    outcome_cols: list[str],
    capture_cols: list[str] = (),
    errors: Callable[[DataFrame], list[ErrorRule]] | None = None,
    checked: Callable[[CheckedRow], dict[str, Checked]] | None = None,
) -> DataFrame:
    """LK1: run the transform on every input row and record the outcome, or the error as data.

    The transform adds columns and keeps ``unit_col`` and ``entry_col``. One outcome column is recorded as its
    text, several as JSON, none as the void marker. ``errors`` are conditions over the transformed row, usually
    about a null that a ``try_`` function left; the first that holds is the outcome. Values print the same on
    every run: maps are sorted and the session time zone must be fixed. A narrow projection, no shuffle.

    ``checked`` needs no such conditions: it gets the transformed row (the input row without a transform) as
    ``CheckedRow`` and returns further columns, built with ordinary operators. Each operation runs in its ``try_`` form,
    and a row in which one overflows, divides by zero or doesn't convert has that error as its outcome, in the order in
    which the columns are given, before the conditions of ``errors``.
    """
    done = transform(inputs) if transform else inputs
    failed = F.lit(None).cast("string")
    if checked:
        made = list(checked(CheckedRow(done)).items())
        # Each result is computed once, as a struct, and taken apart behind it.
        kept = [F.col(f"`{c}`") for c in done.columns if c not in dict(made)]
        pairs = let(F.struct(*[v.pair.alias(f"r{i}") for i, (_, v) in enumerate(made)]), lambda r: r).alias("__made")
        results = [F.col(f"__made.r{i}.value").alias(c) for i, (c, _) in enumerate(made)]
        first = F.coalesce(*[F.col(f"__made.r{i}.error") for i in range(len(made))], F.lit(None).cast("string"))
        done = done.select("*", pairs).select(*kept, *results, first.alias("__failed"))
        failed = F.col("__failed")
    schema = done.schema
    if not outcome_cols:
        value = F.lit(vocab.VOID_OUTCOME)
    elif len(outcome_cols) == 1:
        value = F.coalesce(as_text(F.col(f"`{outcome_cols[0]}`"), schema[outcome_cols[0]].dataType), F.lit("null"))
    else:
        parts = T.StructType([schema[c] for c in outcome_cols])
        value = as_text(F.struct(*[F.col(f"`{c}`") for c in outcome_cols]), parts)
    error = F.lit(None).cast("string")
    for rule in reversed(errors(done) if errors else []):
        message = rule.message if isinstance(rule.message, Column) else F.lit(rule.message)
        error = F.when(rule.condition, F.concat(F.lit(rule.kind + ": "), message)).otherwise(error)
    error = F.coalesce(failed, error)
    captures = [
        F.struct(F.lit(c).alias("name"), as_text(F.col(f"`{c}`"), schema[c].dataType).alias("value"))
        for c in capture_cols
    ]
    none = F.array().cast("array<struct<name: string, value: string>>")
    return done.select(
        F.col(f"`{unit_col}`").cast("string").alias("unit_id"),
        F.col(f"`{entry_col}`").cast("bigint").alias("entry_no"),
        _display(done, input_cols).alias("input"),
        F.coalesce(error, value).alias("outcome"),
        error.isNotNull().alias("is_error"),
        (F.array(*captures) if captures else none).alias("captures"),
    )


# --- LK2, LK3 -------------------------------------------------------------------------------------------------

GENERIC_CAUSES = "time, randomness, a GUID/hash, or an unordered collection"


def quarantine_flaky(
    run_a: DataFrame, run_b: DataFrame, keys: list[str], unit_col: str = "unit_id"
) -> tuple[DataFrame, DataFrame]:
    """LK2: ``(stable rows of run_a, quarantined units with a reason)``.

    Both runs are scrubbed and written down before they are compared: a run that is computed twice would be
    compared with a third evaluation. A unit with any differing, missing or added row leaves the lock as a whole.
    """
    texts = string_columns(run_a, without=[*keys, unit_col])
    run_a = cut_lineage(scrub(run_a, texts, None))
    run_b = cut_lineage(scrub(run_b, texts, None))
    both_keys = list(dict.fromkeys([unit_col, *keys]))
    flaky = (
        verify(run_a, run_b, both_keys, on_duplicates="bag")
        .where(F.col("status") != IDENTICAL)
        .groupBy(unit_col)
        .agg(F.count("*").alias("n_entries"))
    )
    flaky = cut_lineage(flaky)
    stable = run_a.join(flaky.select(unit_col), unit_col, "left_anti").select(*run_a.columns)
    reason = F.lit(
        f"non-deterministic: two runs of the same logic differ, likely {GENERIC_CAUSES}; make it stable, then lock"
    )
    return stable, flaky.withColumn("reason", reason)


_UUID = r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$"
_HASH = r"(?i)^[0-9a-f]{32,128}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"


def _cause(old: Column, new: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("time")
    if isinstance(dtype, T.StringType):
        return (
            F.when(old.rlike(_UUID) & new.rlike(_UUID), "a GUID/hash")
            .when(old.rlike(_HASH) & new.rlike(_HASH), "a GUID/hash")
            .when(old.rlike(_TIME) & new.rlike(_TIME), "time")
            .otherwise("randomness")
        )
    if isinstance(dtype, T.ArrayType):
        return F.when(F.array_sort(old).eqNullSafe(F.array_sort(new)), "an unordered collection").otherwise(
            "randomness"
        )
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        close = F.abs(old - new) <= F.lit(1e-9) * F.greatest(F.abs(old), F.abs(new))
        return F.when(close, "summation order").otherwise("randomness")
    return F.lit("randomness")


def diagnose_flaky(
    run_a: DataFrame,
    run_b: DataFrame,
    keys: list[str],
    unit_col: str,
    obstacles: DataFrame | None = None,
) -> DataFrame:
    """LK3: ``(unit, causes, message)`` for every unit whose two runs differ.

    Known ambient obstacles of the unit, from ``obstacles(unit, obstacles)``, are named first, at most four.
    Otherwise the cause is inferred from how the differing values look. Causes come from a handful of words, so
    collecting them per unit is bounded.
    """
    cols = [c for c in run_a.columns if c not in keys and c != unit_col]
    all_keys = list(dict.fromkeys([unit_col, *keys]))
    found = []
    for c in cols:
        old, new = F.col(f"`old_{c}`"), F.col(f"`new_{c}`")
        found.append(F.when(~old.eqNullSafe(new), _cause(old, new, run_a.schema[c].dataType)))
    pairs = paired(run_a, run_b, all_keys, cols, guard=True)
    unequal = F.when(F.col("in_old") & F.col("in_new"), F.array_compact(F.array(*found))).otherwise(
        F.array(F.lit("randomness"))
    )
    causes = (
        pairs.select(F.col(f"`{unit_col}`"), F.explode(unequal).alias("cause"))
        .groupBy(unit_col)
        .agg(F.array_sort(F.collect_set("cause")).alias("causes"))
    )
    if obstacles is None:
        known = F.array().cast("array<string>")
    else:
        causes = causes.join(obstacles.select(unit_col, "obstacles"), unit_col, "left")
        known = F.slice(F.coalesce("obstacles", F.array().cast("array<string>")), 1, vocab.FLAKY_CAUSES)
    named = F.concat(
        F.lit("non-deterministic: depends on "),
        F.array_join(known, ", "),
        F.lit(", which varies per run; put it behind a seam, then lock again"),
    )
    inferred = F.concat(
        F.lit("non-deterministic: two runs differ, likely "),
        F.array_join("causes", ", "),
        F.lit("; make it stable, then lock again"),
    )
    return causes.select(unit_col, "causes", F.when(F.size(known) > 0, named).otherwise(inferred).alias("message"))


# --- LK12 -----------------------------------------------------------------------------------------------------

_RESULTS = "position int, unit string, success boolean, attempts int, diagnostics array<string>"


@dataclass(frozen=True)
class Target:
    """One thing to lock: a name and a function that returns its ``entries``."""

    name: str
    capture: Callable[[], DataFrame]


def lock_batch(
    spark: SparkSession, targets: list[Target], max_targets: int | None = None
) -> tuple[DataFrame | None, DataFrame]:
    """LK12: capture many targets as one union, so that one action runs them all.

    A target whose plan does not resolve is isolated and reported; the others complete. Results keep the input
    order. Targets beyond ``max_targets`` are reported as not processed.
    """
    entries, results = None, []
    for i, target in enumerate(targets):
        if max_targets is not None and i >= max_targets:
            results.append((i, target.name, False, 0, ["not processed"]))
            continue
        try:
            one = target.capture()
        except Exception as error:  # whatever a target raises while it is planned is its own
            results.append((i, target.name, False, 1, _diagnostics(error)))
            continue
        entries = one if entries is None else entries.unionByName(one)
        results.append((i, target.name, True, 1, []))
    return entries, spark.createDataFrame(results, _RESULTS)


def lock_batch_to(
    spark: SparkSession, targets: list[Target], path: str, max_targets: int | None = None
) -> DataFrame:
    """LK12 at run time: write the entries of all targets below ``path`` and report on each.

    One job writes them all. If it fails, the batch is halved and each half is tried by itself, until the target that
    fails stands alone and is reported; the rest completes. A failed job commits nothing, so no entry is written
    twice. ``attempts`` counts the jobs a target took part in.
    """
    limit = len(targets) if max_targets is None else max_targets
    results = {i: (False, 0, ["not processed"]) for i in range(limit, len(targets))}
    planned: dict[int, DataFrame] = {}
    for i, target in enumerate(targets[:limit]):
        try:
            planned[i] = target.capture()
        except Exception as error:  # whatever a target raises while it is planned is its own
            results[i] = (False, 1, _diagnostics(error))

    def attempt(part: list[int], tried: int) -> None:
        if not part:
            return
        try:
            reduce(DataFrame.unionByName, [planned[i] for i in part]).write.mode("append").parquet(path)
            results.update({i: (True, tried, []) for i in part})
        except Exception as error:
            if len(part) == 1:
                results[part[0]] = (False, tried, _diagnostics(error))
                return
            attempt(part[: len(part) // 2], tried + 1)
            attempt(part[len(part) // 2 :], tried + 1)

    attempt(sorted(planned), 1)
    rows = [(i, targets[i].name, *results[i]) for i in sorted(results)]
    return spark.createDataFrame(rows, _RESULTS)


def _diagnostics(error: Exception) -> list[str]:
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return list(dict.fromkeys(line for line in lines if not line.startswith("at ")))


# --- LK7 ------------------------------------------------------------------------------------------------------


class NothingMatches(Exception):
    """No changed entry is in the requested scope."""


@dataclass
class Acceptance:
    """The re-based baseline and what happened."""

    baseline: DataFrame
    accepted: int
    remaining: int
    errors: list[str] = field(default_factory=list)


def accept(
    baseline: DataFrame,
    current: DataFrame,
    keys: list[str],
    name: str | None = None,
    accept_all: bool = False,
    name_col: str | None = None,
) -> Acceptance:
    """LK7: promote changed entries in scope to the baseline, scrubbed; everything else stays as it was.

    A scope is required: a part of the entry name (ignoring case) or all. Missing and added rows are never
    promoted. The new baseline is one left join that picks the side per row; write it as the next version. Keys that
    repeat on either side make it fail, so a baseline never gains rows.
    """
    if not accept_all and not (name and name.strip()):
        raise ValueError("say which changes to accept: a part of the name, or all")
    errors = schema_break(baseline.schema, current)
    if errors:
        raise AnalysisException("; ".join(errors))
    cols = [c for c in baseline.columns if c not in keys]
    now = scrub(current.select(*baseline.columns), text_columns(baseline, without=keys), None)
    label = F.col(f"`{name_col or keys[0]}`").cast("string")
    in_scope = F.lit(True) if accept_all else F.contains(F.lower(label), F.lit(name.lower()))
    both = F.col("in_old") & F.col("in_new")
    pairs = (
        paired(baseline, now, keys, cols, how="left", guard=True)
        .withColumn("__changed", both & is_changed(cols))
        .withColumn("__accept", F.col("__changed") & in_scope)
    )
    total, changed, accepted = pairs.agg(
        F.count("*"), F.count_if("__changed"), F.count_if("__accept")
    ).first()
    if total == 0:
        raise NothingMatches("the baseline is empty: lock something first")
    if changed == 0:
        return Acceptance(baseline, 0, 0)
    if accepted == 0:
        shown = [
            str(r[0]) for r in pairs.where("__changed").select(label).distinct().limit(vocab.DIAGNOSTIC_LINES).collect()
        ]
        raise NothingMatches(f"no changed entry matches '{name}'; changed are for example {', '.join(sorted(shown))}")
    rebased = pairs.select(
        *[
            F.col(f"`{c}`")
            if c in keys
            else F.when(F.col("__accept"), F.col(f"`new_{c}`")).otherwise(F.col(f"`old_{c}`")).alias(c)
            for c in baseline.columns
        ]
    )
    return Acceptance(rebased, accepted, changed - accepted)

