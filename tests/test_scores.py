import pytest
from pyspark.sql import functions as F

from driftlock.operators import risk, scores
from driftlock.plans import analyze as plans
from driftlock.operators.ordered import prefix_sum, rank_hotspots, spend_ceiling
from driftlock.sources import reports
from driftlock.sources.baseline import write_report
from driftlock.sources.corpus import scan_corpus

UNIT = """unit_id string, display_name string, path string, start_line int, signature string, complexity int, line_count int,
          caller_count bigint, has_tests boolean, is_public boolean, tags array<string>, landmines array<string>,
          seams array<string>, obstacles array<string>"""


def unit(uid, complexity=1, lines=1, callers=0, tested=False, public=True, tags=(), mines=(), seams=(), obstacles=(), path="a.cs"):
    return (uid, f"T.{uid}", path, 1, "s", complexity, lines, callers, tested, public, list(tags), list(mines), list(seams), list(obstacles))


def scored(spark, *units):
    return risk.risk_components(spark.createDataFrame(list(units), UNIT))


def test_all_caps_reach_ten(spark):
    row = scored(spark, unit("x", 99, 999, 99, False, True, ["money", "auth"], ["WCF"])).first()
    assert row.risk == 10.0 and len(row.components) == 6


def test_untested_outranks_tested_and_tags_add_up(spark):
    rows = {r.unit_id: r.risk_raw for r in scored(spark, unit("a"), unit("b", tested=True), unit("c", tags=["io"])).collect()}
    assert rows["a"] - rows["b"] == pytest.approx(2.5) and rows["c"] - rows["a"] == pytest.approx(1.5 * 0.75)


def test_reason(spark):
    rows = scored(spark, unit("a", 14, 40, 1, False, tags=["money"]), unit("b", 0, 0, 0, True), unit("c", 2, 10, 0, True))
    got = {r.unit_id: r.reason for r in rows.withColumn("reason", risk.reason_text(F.col("components"))).collect()}
    assert got["a"] == "0 tests, complexity 14, money, 40 lines, 1 caller"
    assert got["b"] == "has tests" and got["c"] == "complexity 2, 10 lines, has tests"


def test_report(spark):
    rows = scored(
        spark,
        unit("low", 1, tested=True, path="B.cs"),
        unit("high", 20, 200, path="a.cs"),
        unit("mid", 8, tested=True, path="A.cs"),
        unit("low2", 1, path="b.cs"),
    )
    assert [r.unit_id for r in risk.hotspots(rows).collect()] == ["high", "low2", "mid", "low"]
    assert risk.hotspots(rows, 1).first().unit_id == "high"
    s = risk.readiness_summary(rows).first()
    assert (s.units, s.files, s.tested, s.high_risk_untested, s.behaviour_coverage) == (4, 2, 2, 1, 0.5)
    empty = risk.readiness_summary(rows.limit(0)).first()
    assert (empty.units, empty.behaviour_coverage) == (0, 0.0)


def test_threshold_uses_the_unrounded_score(spark):
    rows = scored(spark, unit("x", complexity=9, lines=10)).withColumn("risk_raw", F.lit(3.449)).withColumn("risk", F.lit(3.5))
    assert risk.readiness_summary(rows).first().high_risk_untested == 0


def test_seams_and_landmines(spark):
    rows = scored(spark, unit("x", 20, 200, obstacles=["File"], mines=["WCF", "EF6"]), unit("y", mines=["wcf"]))
    assert risk.readiness_summary(rows).first().seams_to_introduce == 1
    counts = risk.landmine_counts(rows)
    assert {(r.landmine, r.n) for r in counts.collect()} == {("WCF", 2), ("EF6", 1)}
    assert risk.landmine_summary(counts).first()[0] == "2 WCF, 1 EF6"
    assert risk.landmine_summary(counts.limit(0)).first()[0] == "none detected"


def test_lock_run_funnel(spark):
    rows = scored(spark, unit("a", 9, tags=["io"]), unit("b", 8, tags=["money"]), unit("c", 7, path="Legacy/x.cs"), unit("d", 6), unit("e", 5), unit("t", tested=True))
    selected, funnel = risk.plan_lock_run(rows, ["legacy/"], max_targets=2)
    f = funnel.first()
    assert (f.matched, f.excluded, f.side_effecting, f.sensitive, f.selected, f.unlocked) == (5, 1, 1, 1, 2, 1)
    assert [r.unit_id for r in selected.collect()] == ["b", "d"]
    assert risk.plan_lock_run(rows, allow_side_effects=True)[1].first().side_effecting == 0


def test_mutation_report(spark):
    body = """{"files":{"src\\\\A.cs":{"mutants":[{"status":"Killed"},{"status":"Survived"},{"status":"NoCoverage"},{"status":"Ignored"},{}]},
               "src/B.cs":{"mutants":[{"status":"Killed"},{"status":"Killed"},{"status":"Timeout"}]},"C.cs":{"mutants":[{"status":"Ignored"}]},"D.cs":7}}"""
    mutants = reports.parse_mutants(spark.createDataFrame([(body,), ("not json",), ('{"files":[]}',)], "value string"))
    got = {r.file: (r.killed, r.survived, r.no_coverage, r.timeout, r.tested, round(r.score, 1)) for r in scores.mutation_scores(mutants).collect()}
    assert got == {"A.cs": (1, 1, 1, 0, 3, 33.3), "B.cs": (2, 0, 0, 1, 3, 100.0), None: (3, 1, 1, 1, 6, 66.7)}


def test_coverage_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<coverage lines-covered="5" lines-valid="10" branches-covered="x"><packages/></coverage>')
    (tmp_path / "b.xml").write_text('<coverage lines-covered="1" lines-valid="2" branches-covered="3" branches-valid="4"></coverage>')
    row = scores.coverage_totals(reports.read_coverage(spark, str(tmp_path))).first()
    assert tuple(row) == (6, 12, 3, 4, 0.5, 0.75)


def test_pricing(spark):
    usage = spark.createDataFrame(
        [("small-haiku-x", 1_000_000, 1_000_000, 0, 0), ("mid", 1_000_000, 1_000_000, 0, 0), ("OPUS-1", 1_000_000, 1_000_000, 0, 0), ("s", 0, 0, 1_000_000, 1_000_000)],
        "model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint",
    )
    priced = scores.price_usage(usage)
    assert [float(r.cost_usd) for r in priced.collect()] == [6.0, 18.0, 30.0, 4.05]
    total = scores.usage_totals(priced).first()
    assert (total.calls, float(total.cost_usd)) == (4, 58.05)
    assert scores.usage_totals(priced.limit(0)).first().calls == 0


def test_ceiling_lets_the_crossing_call_run(spark):
    calls = spark.createDataFrame([("r", i, 1.0) for i in range(5)], "run string, n int, c double").withColumn("cost_usd", F.col("c").cast("decimal(28,10)"))
    got = [r.admitted for r in spend_ceiling(calls, 2, ["run"], [F.col("n")]).orderBy("n").collect()]
    assert got == [True, True, False, False, False]


def test_prefix_sum_is_the_same_split_or_not(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("g"), (F.col("id") % 11).alias("x")).repartition(5)
    plain = prefix_sum(df, ["g"], [F.col("id")], F.col("x"), "s")
    split = prefix_sum(df, ["g"], [F.col("id")], F.col("x"), "s", plain_rows=10)
    assert plain.count() == 5000 and plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_global_rank(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 101).alias("x"))
    ranked = rank_hotspots(df, [F.desc("x"), F.col("id")])
    want = sorted(((r.id, r.x) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    assert [r.id for r in ranked.orderBy("position").collect()] == [i for i, _ in want]


def test_patterns_and_usage(spark, tmp_path):
    path = tmp_path / "ignore"
    path.write_text("# c\n\n  src/Gen \nSRC/gen\n*.tmp\n")
    got = [r.pattern for r in reports.load_patterns(spark, ["a, b,,A", "#x"], str(path)).collect()]
    assert sorted(got) == ["#x", "*.tmp", "a", "b", "src/Gen"]
    rows = [
        ("openai", '{"usage":{"prompt_tokens":10,"completion_tokens":4,"prompt_tokens_details":{"cached_tokens":25}}}'),
        ("anthropic", '{"usage":{"input_tokens":7,"cache_creation_input_tokens":2}}'),
        ("anthropic", "broken"),
    ]
    log = reports.read_usage_log(spark.createDataFrame(rows, "p string, b string"), "b", "p").drop("p", "b").collect()
    assert [tuple(r) for r in log] == [(0, 4, 25, 0), (7, 0, 0, 2), (0, 0, 0, 0)]


def test_corpus(spark, tmp_path):
    for name in ("a/x.cs", "a/bin/y.cs", "OBJ/z.cs", "binary/w.cs", "a/x.txt", "sp ace/v+1.cs", "p%41%.cs"):
        file = tmp_path / "bin" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("é;")
    files = scan_corpus(spark, str(tmp_path / "bin"), "*.cs").collect()
    names = sorted(r.path.split("/bin/", 1)[1] for r in files)
    assert names == ["a/x.cs", "binary/w.cs", "p%41%.cs", "sp ace/v+1.cs"]
    assert {(r.content, r.length) for r in files} == {("é;", 3)}


def test_facts_to_report(spark):
    rows = [
        ("a", "Pay.Run", "src/Pay.cs", ["System.ServiceModel"], ["Page"], "Run", 0),
        ("b", "Pay.Vat", "src/Pay.cs", [], [], "CalculateVat", 1),
        ("g", "Form.Init", "src/Form.Designer.cs", [], [], "Init", 0),
    ]
    units = spark.createDataFrame(
        rows, "unit_id string, display_name string, path string, usings array<string>, base_types array<string>, name string, arity int"
    ).selectExpr(
        "*", "array() as attributes", "1 as start_line", "'s' as signature", "5 as complexity", "10 as line_count", "true as is_public",
        "cast(array() as array<string>) as seams", "cast(array() as array<string>) as obstacles",
    )
    refs = spark.createDataFrame([("a", "CalculateVat", 1, None), ("g", "CalculateVat", 1, None)], "caller_id string, name string, arity int, resolved_id string")
    tests = spark.createDataFrame([("b",), ("b",)], "unit_id string")
    done = plans.score_units(units.withColumn("attributes", F.col("attributes").cast("array<string>")), ["name"], refs, tests)
    got = {r.unit_id: (r.tags, r.landmines, r.caller_count, r.has_tests) for r in done.collect()}
    assert got == {"a": ([], ["WCF", "WebForms"], 0, False), "b": (["money"], [], 1, True)}
    report = plans.readiness_report(done, top=1)
    assert report["summary"].first().units == 2 and report["hotspots"].first().unit_id == "a"
    mutants = spark.createDataFrame([("x/pay.CS", "Killed"), ("x/pay.CS", "Survived")], "file string, status string")
    overlay = plans.score_overlay(done, mutants.withColumn("file", reports.normalized_file(F.col("file"))))
    assert {r.score for r in overlay["rows"].collect()} == {50.0} and overlay["headline"].first()[0] == 50.0
    assert overlay["mean_headline"].first()[0] == 50.0 and overlay["files"].first().units == 2


def test_report_file(spark, tmp_path):
    write_report(scored(spark, unit("x")), str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).first().asDict()
    assert row["unitId"] == "x" and "riskRaw" not in row and "seams" not in row and row["components"][0]["name"] == "complexity"
