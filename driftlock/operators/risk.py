"""Risk score, report order, target selection, report summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlock import vocab
from driftlock.functions.bind import let
from driftlock.functions.names import base_name, simple_name
from driftlock.operators.lookup import lookup_join
from driftlock.operators.tagging import (
    UNIT_TEXTS,
    classify_seamability,
    is_sensitive,
    is_side_effecting,
    matches_any,
)

# --- PRJ16, PRJ17 ---------------------------------------------------------------------------------------------


def half_even(value: Column, digits: int) -> Column:
    """Banker's rounding of a double, scaled the way the score is defined."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def risk_components(
    df: DataFrame,
    weights: dict[str, float] = vocab.RISK_WEIGHTS,
    caps: dict[str, float] = vocab.RISK_CAPS,
) -> DataFrame:
    """PRJ16: add ``components``, ``risk_raw`` and ``risk`` (rounded half-even to one digit).

    Needs ``complexity``, ``line_count``, ``caller_count``, ``has_tests``, ``tags`` and ``landmines``.
    """
    n_tags = F.coalesce(F.array_size("tags"), F.lit(0))
    n_mines = F.coalesce(F.array_size("landmines"), F.lit(0))
    callers = F.col("caller_count")

    def capped(value: Column, name: str) -> Column:
        share = F.coalesce(value, F.lit(0)) / F.lit(float(caps[name]))
        return F.lit(0.0) if caps[name] <= 0 else F.least(F.lit(1.0), share)

    def text(value: Column) -> Column:
        return value.cast("string")

    parts = [
        (
            "complexity",
            capped(F.col("complexity"), "complexity"),
            F.concat(F.lit("complexity "), text(F.col("complexity"))),
        ),
        (
            "untested",
            F.when(F.col("has_tests"), 0.0).otherwise(1.0),
            F.when(F.col("has_tests"), "has tests").otherwise("0 tests"),
        ),
        (
            "domain",
            F.when(n_tags == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.25 * n_tags)),
            F.when(n_tags == 0, "no domain tags").otherwise(F.array_join("tags", "+")),
        ),
        (
            "blast-radius",
            capped(callers, "blast-radius"),
            F.concat(text(callers), F.when(callers == 1, " caller").otherwise(" callers")),
        ),
        ("size", capped(F.col("line_count"), "size"), F.concat(text(F.col("line_count")), F.lit(" lines"))),
        (
            "landmine",
            F.when(n_mines > 0, 1.0).otherwise(0.0),
            F.when(n_mines > 0, F.array_join("landmines", "+")).otherwise("none"),
        ),
    ]
    structs, total = [], None
    for name, normalized, detail in parts:
        contribution = F.lit(float(weights[name])) * normalized
        total = contribution if total is None else total + contribution
        structs.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(float(weights[name])).alias("weight"),
                normalized.alias("normalized"),
                detail.alias("detail"),
                contribution.alias("contribution"),
            )
        )
    return df.withColumns({"components": F.array(*structs), "risk_raw": total}).withColumn(
        "risk", half_even(F.col("risk_raw"), 1)
    )


def reason_text(components: Column) -> Column:
    """PRJ17: details of the contributing components, largest first; the test status is always stated."""
    placed = F.transform(
        F.filter(components, lambda c: c["contribution"] > 0),
        lambda c, i: F.struct(
            (-c["contribution"]).alias("least_first"), i.alias("place"), c["detail"].alias("detail")
        ),
    )
    tested = F.transform(
        F.filter(components, lambda c: (c["name"] == "untested") & (c["contribution"] == 0)), lambda c: c["detail"]
    )
    stated = let(
        F.transform(F.array_sort(placed), lambda c: c["detail"]),
        lambda details: F.concat(details, F.filter(tested, lambda t: ~F.array_contains(details, t))),
    )
    return let(stated, lambda full: F.when(F.size(full) == 0, "low risk").otherwise(F.array_join(full, ", ")))


# --- SL1 to SL5 -----------------------------------------------------------------------------------------------

# Ties keep source order, written out so that it does not depend on partitioning.
SOURCE_ORDER = ["path", "start_line", "unit_id"]


def report_order() -> list[Column]:
    """SL1: rounded risk, then complexity, both descending, then source order."""
    return [F.desc("risk"), F.desc("complexity"), *[F.col(c) for c in SOURCE_ORDER]]


def hotspots(scored: DataFrame, top: int = 0) -> DataFrame:
    """SL1: units in report order; a positive ``top`` keeps the first ones by a distributed top-k."""
    ordered = scored.orderBy(*report_order())
    return ordered.limit(top) if top > 0 else ordered


def select_riskiest(scored: DataFrame, top: int) -> DataFrame:
    """SL2: the first untested public units in report order."""
    return hotspots(scored.where(~F.col("has_tests") & F.col("is_public")), max(1, top))


def select_targets(scored: DataFrame, needle: str | None, top: int) -> DataFrame:
    """SL3: every unit whose display name or id contains the needle; without a needle the riskiest ones."""
    if needle and needle.strip():
        low = F.lit(needle.lower())
        return scored.where(
            F.contains(F.lower("display_name"), low) | F.contains(F.lower("unit_id"), low)
        )
    return select_riskiest(scored, top)


def cap_targets(
    units: DataFrame, max_targets: int = vocab.MAX_TARGETS, order: list[Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """SL4: the selected units, and a one-row table saying how many were left unlocked."""
    n = max(1, max_targets)
    left_out = units.agg(
        F.count("*").alias("eligible"), F.greatest(F.count("*") - n, F.lit(0)).alias("unlocked_count")
    )
    return units.orderBy(*(order or report_order())).limit(n), left_out


def plan_lock_run(
    scored: DataFrame,
    patterns: list[str] | DataFrame = (),
    needle: str | None = None,
    top: int = vocab.MAX_TARGETS,
    max_targets: int = vocab.MAX_TARGETS,
    allow_side_effects: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """SL5: the units to lock, and the funnel that led to them as one row of counts.

    Named targets keep source order, the riskiest keep report order.
    """
    n = max(1, max_targets)
    excluded, side, eligible = F.col("__excluded"), F.col("__side"), F.col("__eligible")
    flagged = (
        select_targets(scored, needle, top)
        .withColumns(
            {
                "__excluded": matches_any([F.col(c) for c in UNIT_TEXTS], patterns),
                "__side": is_side_effecting(F.col("tags")) & F.lit(not allow_side_effects),
            }
        )
        .withColumn("__eligible", ~excluded & ~side)
    )
    funnel = flagged.agg(
        F.count("*").alias("matched"),
        F.count_if(excluded).alias("excluded"),
        F.count_if(~excluded & side).alias("side_effecting"),
        F.count_if(eligible & is_sensitive(F.col("tags"))).alias("sensitive"),
        F.least(F.count_if(eligible), F.lit(n)).alias("selected"),
        F.greatest(F.count_if(eligible) - n, F.lit(0)).alias("unlocked"),
    )
    named = bool(needle and needle.strip())
    order = [F.col(c) for c in SOURCE_ORDER] if named else report_order()
    selected = flagged.where(eligible).drop("__excluded", "__side", "__eligible").orderBy(*order).limit(n)
    return selected, funnel


# --- AG1, AG2, AG9 --------------------------------------------------------------------------------------------


def readiness_summary(scored: DataFrame, threshold: float = vocab.HIGH_RISK_THRESHOLD) -> DataFrame:
    """AG1: headline counts in one row. High-risk is judged on the unrounded score."""
    high = ~F.col("has_tests") & (F.col("risk_raw") >= F.lit(threshold))
    needs_seam = classify_seamability(F.col("obstacles"), F.col("seams")) == "NeedsSeam"
    return scored.agg(
        F.count("*").alias("units"),
        F.countDistinct(F.when(F.col("path") != "", F.lower("path"))).alias("files"),
        F.count_if("has_tests").alias("tested"),
        F.count_if(high).alias("high_risk_untested"),
        F.count_if(high & needs_seam).alias("seams_to_introduce"),
        F.coalesce(F.try_divide(F.count_if("has_tests"), F.count("*")), F.lit(0.0)).alias("behaviour_coverage"),
    )


def landmine_counts(units: DataFrame, order: str | None = None) -> DataFrame:
    """AG2: units per landmine, ignoring case.

    The spelling is that of the first unit by the column ``order``; without one, the alphabetically first.
    """
    place = F.col(order) if order else F.lit(0)
    return (
        units.select(place.alias("__place"), F.posexplode("landmines").alias("__pos", "landmine"))
        .groupBy(F.lower("landmine").alias("__key"))
        .agg(F.min(F.struct("__place", (F.col("__pos") if order else F.lit(0)).alias("pos"), "landmine"))["landmine"].alias("landmine"), F.count("*").alias("n"))
        .select("landmine", "n")
    )


def landmine_summary(counts: DataFrame) -> DataFrame:
    """AG2: the counts as one line of text, most frequent first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "landmine", "n")))
    text = F.transform(ordered, lambda r: F.concat_ws(" ", r["n"].cast("string"), r["landmine"]))
    return counts.agg(
        F.when(F.count("*") == 0, "none detected").otherwise(F.array_join(text, ", ")).alias("summary")
    )


def overlay_scores(rows: DataFrame, scores: DataFrame, path: str = "path") -> DataFrame:
    """JN6: add the file score by file name, ignoring case; null when the file has none.

    ``scores(file, score)`` is reduced to one row per name first, so the join cannot multiply rows.
    """
    by_name = scores.groupBy(F.lower(base_name(F.col("file"))).alias("__file")).agg(F.max("score").alias("score"))
    return lookup_join(rows.withColumn("__file", F.lower(base_name(F.col(path)))), by_name, ["__file"]).drop("__file")


def file_rollup(rows: DataFrame) -> DataFrame:
    """AG9: units, worst risk, untested units and score per file name."""
    return rows.groupBy(base_name(F.col("path")).alias("file")).agg(
        F.count("*").alias("units"),
        F.max("risk").alias("worst_risk"),
        F.count_if(~F.col("has_tests")).alias("untested"),
        F.max("score").alias("score"),
    )


def headline_score(rows: DataFrame, overall: float | None = None) -> DataFrame:
    """AG9: the given overall score, else the mean of file scores repeated once per unit, rounded half-even."""
    value = F.lit(overall) if overall is not None else F.rint(F.avg("score"))
    return rows.agg(value.alias("headline"))


def dashboard_rows(scored: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """SRC11: the per-unit row behind a dashboard."""
    rows = scored if scores is None else overlay_scores(scored, scores)
    score = F.lit(None).cast("double") if scores is None else F.rint("score")
    return rows.select(
        F.col("unit_id").alias("id"),
        F.col("display_name").alias("name"),
        base_name(F.col("path")).alias("file"),
        "path",
        F.col("start_line").alias("line"),
        "signature",
        F.concat(F.lit("lock --target "), simple_name(F.col("display_name"))).alias("next_step"),
        F.col("complexity").alias("cx"),
        F.col("caller_count").alias("blast"),
        F.col("line_count").alias("lines"),
        "tags",
        "landmines",
        F.col("has_tests").alias("tested"),
        F.col("is_public").alias("entry"),
        "risk",
        score.alias("score"),
        F.transform(
            "components",
            lambda c: F.struct(
                c["name"].alias("name"),
                c["detail"].alias("detail"),
                half_even(c["contribution"], 2).alias("contribution"),
            ),
        ).alias("components"),
    )
