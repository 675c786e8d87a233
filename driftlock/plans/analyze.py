"""From raw unit facts to the ranked report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.scrub import scrub
from driftlock.operators.graph import blast_radius, mark_tested, resolve_edges
from driftlock.operators.risk import (
    dashboard_rows,
    file_rollup,
    headline_score,
    hotspots,
    landmine_counts,
    readiness_summary,
    risk_components,
)
from driftlock.operators.scores import mutation_scores
from driftlock.operators.tagging import detect_landmines, flag_generated_path, matches_any, tag_domains


def score_units(
    units: DataFrame,
    signals: list[str],
    refs: DataFrame | None = None,
    test_refs: DataFrame | None = None,
) -> DataFrame:
    """Tag, link and score units; generated code is left out first.

    Needs ``path``, ``usings``, ``base_types``, ``attributes`` and the signal columns besides the plain ``units``
    columns. References and test references are optional tables.
    """
    units = units.where(~flag_generated_path(F.col("path")))
    if refs is not None:
        # Generated code is not analysed, so it does not count as a caller either.
        callers = units.select(F.col("unit_id").alias("caller_id")).distinct()
        refs = refs.join(callers, "caller_id", "left_semi")
        units = blast_radius(units, resolve_edges(units, refs))
    if test_refs is not None:
        units = mark_tested(units, test_refs)
    return risk_components(detect_landmines(tag_domains(units, signals)))


def readiness_report(scored: DataFrame, threshold: float = vocab.HIGH_RISK_THRESHOLD, top: int = 0) -> dict[str, DataFrame]:
    """The report as tables: one-row summary, landmine counts, ranked hotspots."""
    return {
        "summary": readiness_summary(scored, threshold),
        "landmines": landmine_counts(scored),
        "hotspots": hotspots(scored, top),
    }


def score_overlay(scored: DataFrame, mutants: DataFrame) -> dict[str, DataFrame]:
    """LK15: mutation scores per file laid over the dashboard rows, the file roll-up and the headline."""
    scores = mutation_scores(mutants)
    per_file = scores.where(~F.col("is_overall")).select("file", "score")
    overall = scores.where("is_overall").select(F.rint("score").alias("headline"))
    rows = dashboard_rows(scored, per_file)
    return {
        "rows": rows,
        "files": file_rollup(rows.withColumnRenamed("tested", "has_tests")),
        "headline": overall,
        "mean_headline": headline_score(rows),
    }


def unit_text(namespace: Column, type_name: Column, signature: Column, callees: Column, source: Column) -> Column:
    """The text that would describe one unit to somebody outside."""
    calls = F.when(F.size(callees) > 0, F.concat(F.lit("calls: "), F.array_join(callees, "; ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("namespace: "), namespace),
        F.concat(F.lit("type: "), type_name),
        F.concat(F.lit("unit: "), signature),
        calls,
        F.lit("source:"),
        source,
    )


def egress_payload(units: DataFrame, patterns: list[str] | DataFrame) -> DataFrame:
    """PRJ15: ``payload(unit_id, text, redactions, n_chars)``, what would leave, for audit; nothing is sent.

    Units that match a never-send pattern are dropped before any text is built. Needs ``namespace``,
    ``type_name``, ``signature``, ``callees`` and ``source``.
    """
    allowed = units.where(~matches_any([F.col("path"), F.col("display_name"), F.col("unit_id")], patterns))
    text = unit_text(*[F.col(c) for c in ("namespace", "type_name", "signature", "callees", "source")])
    payload = scrub(allowed.select("unit_id", text.alias("text")), ["text"])
    return payload.withColumn("n_chars", F.length("text"))
