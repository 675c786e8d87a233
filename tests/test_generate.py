import pytest
from pyspark.sql import functions as F

from driftlock.operators import generate as gen

RULES = "rule_id string, params array<struct<name: string, type: string>>, rule_text string"

PARCEL = """if (parcel.Length < 12) throw new ArgumentException(); if (parcel.Length > 90) return -1;
    var mixed = parcel.Any(ch => char.IsLetter(ch)) && parcel.Any(ch => char.IsDigit(ch));
    return parcel.StartsWith("#") ? 0 : mixed ? 1 : 2;"""
ORDER = 'return orderRef.StartsWith("ORD:") && orderRef.Contains("/") && orderRef.EndsWith("Z") ? Ship(orderRef) : null;'
CARRIER = 'fee = carrier == "AIR" ? 9 : "SEA" == carrier ? 4 : 6;'
PLACE = r'static bool Known(string place) { return Regex.IsMatch(place, @"^\d{5}-[a-f]{2}$"); }'


@pytest.fixture(scope="module")
def guards(spark):
    rows = [("t", [("parcel", "string")], PARCEL), ("s", [("orderRef", "string")], ORDER), ("r", [("carrier", "string")], CARRIER), ("m", [("place", "string")], PLACE)]
    return {r.rule_id: r for r in gen.extract_guards(spark.createDataFrame(rows, RULES)).collect()}


def test_guards(guards):
    t = guards["t"].guards
    assert (t.lengths, t.prefix, t.letter, t.digit, guards["t"].has_guards) == ([12, 90], "#", True, True, True)
    s = guards["s"].guards
    assert (s.prefix, s.contains, s.suffix) == ("ORD:", ["/"], "Z")
    assert guards["r"].guards.exact == ["AIR", "SEA"] and not guards["r"].has_guards
    assert guards["m"].guards.regexes == [r"^\d{5}-[a-f]{2}$"] and guards["m"].has_guards


def witnesses(spark, text, param, found=None):
    df = spark.createDataFrame([(text,)], "t string")
    values = gen.guard_witnesses(gen.guards(F.col("t"), F.lit(param)), found)
    return df.select(values.alias("v")).first().v


def test_witness_and_near_misses(spark):
    got = witnesses(spark, PARCEL, "parcel")
    assert [len(x) for x in got] == [12, 11, 12, 12, 13, 91]
    assert got[2].isdigit() and got[3].isalpha() and got[4].startswith("#")
    ref = witnesses(spark, ORDER, "orderRef")
    assert ref[2] == "ORD:" + ref[0] and ref[3].endswith("/") and ref[4].endswith("Z")


def test_regex_witnesses_come_from_the_data(spark):
    data = spark.createDataFrame([("12345-ab",), ("zzz",), ("00000-aa",), (None,)], "v string")
    found = gen.pattern_witness(data, "v", [r"^\d{5}-[a-f]{2}$", r"^(?=.*\d).{20,}$"]).collect()
    assert tuple(found[0])[1:] == ("00000-aa", "zzz", 2, 1) and tuple(found[1])[1:] == (None, "00000-aa", 0, 3)
    given = F.create_map(F.lit(r"^\d{5}-[a-f]{2}$"), F.array(F.lit("00000-aa"), F.lit("zzz")))
    assert {"00000-aa", "zzz"} <= set(witnesses(spark, PLACE, "place", given))


def literals(spark, text, dialect="csharp"):
    rows = gen.mine_literals(spark.createDataFrame([("r", [], text)], RULES), dialect).collect()
    return {(r.kind, r.literal) for r in rows}


def test_literals_that_decide(spark):
    text = """if (amount > 1000m && qty >= 10 || 5 < n) return amount * 0.02m; if (x == 1.5 || y != 2L) {}
              switch (code) { case "A": case 7: break; } var z = kind is 9 or "B"; s.EndsWith("x > 99"); s.IndexOf("q", 4);
              return mode switch { "NO" => 3, 12 => 4, _ => 5 }; string.Format("{0}", 88); i += 77; a << 3;"""
    found = literals(spark, text)
    assert found == {
        ("decimal", "1000"), ("int", "10"), ("int", "5"), ("double", "1.5"), ("int", "2"), ("string", "A"), ("int", "7"),
        ("int", "9"), ("string", "B"), ("string", "x > 99"), ("string", "q"), ("int", "4"), ("string", "NO"), ("int", "12"),
    }
    sql = literals(spark, "a >= 10 AND b IN ('x', 'y', 3) AND c LIKE 'z%' AND d BETWEEN 4 AND 6 AND e * 7", "sql")
    assert sql == {("int", "10"), ("string", "x"), ("string", "y"), ("int", "3"), ("string", "z%"), ("int", "4"), ("int", "6")}


def candidate_lists(spark, params, text):
    rows = gen.candidate_rows(gen.rule_candidates(spark.createDataFrame([("r", params, text)], RULES))).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.param_no, r.candidate_no)):
        out.setdefault(r.param, []).append(r.value)
    return out


def test_candidates_per_type(spark):
    params = [("i", "int"), ("d", "decimal"), ("f", "double"), ("b", "bool"), ("c", "char"), ("s", "string"), ("e", "enum(A,B)"), ("o", "Order")]
    got = candidate_lists(spark, params, 'if (i > 10 || d < 5.5m || f >= 2.5 || s == "NO") x();')
    assert got == {
        "i": ["9", "10", "11", "0", "1", "-1"],
        "d": ["4.5", "5.5", "6.5", "10", "0", "1"],
        "f": ["1.5", "2.5", "3.5", "0.0", "1.0"],
        "b": ["false", "true"],
        "c": ["a", "0"],
        "s": ["Ab1Ab1Ab1A", "12345", "NO", "", None],
        "e": ["A", "B"],
        "o": [None],
    }


def rows_of(df):
    return [list(r.row) for r in df.orderBy("rule_id", "row_no").collect()]


def test_one_hot_and_round_robin(spark):
    rule = [("r", [("i", "int"), ("b", "bool")], "i > 3")]
    found = gen.rule_candidates(spark.createDataFrame(rule, RULES))
    assert rows_of(gen.one_hot_rows(found)) == [["2", "false"], ["3", "false"], ["4", "false"], ["0", "false"], ["1", "false"], ["-1", "false"], ["2", "true"]]
    assert rows_of(gen.struct_variants(spark.createDataFrame(rule, RULES)))[:4] == [["1", "true"], ["3", "true"], ["1", "false"], ["0", "true"]]
    nothing = gen.rule_candidates(spark.createDataFrame([("r", [], "x")], RULES))
    assert rows_of(gen.one_hot_rows(nothing)) == [[]]
    assert gen.sampled_rows(nothing).count() == 0


def test_at_most_twelve_one_hot_rows(spark):
    params = [(f"p{i}", "int") for i in range(5)]
    found = gen.rule_candidates(spark.createDataFrame([("r", params, "p0 > 3")], RULES))
    assert gen.one_hot_rows(found).count() == 12


def test_draws_are_in_range_repeatable_and_new(spark):
    rules = [(f"r{i}", [("i", "int"), ("d", "decimal"), ("x", "double"), ("b", "bool"), ("s", "string")], "i > 2000 && i < -7 && d > 90000m") for i in range(50)]
    df = spark.createDataFrame(rules, RULES)
    found = gen.rule_candidates(df)
    drawn = gen.sampled_rows(found)
    rows = [(r.rule_id, tuple(r.row)) for r in drawn.collect()]
    assert len(rows) == len(set(rows)) == 800
    for _, (i, d, x, b, s) in rows:
        assert -12 <= int(i) <= 4100 and -10 <= float(d) <= 180100 and -10 <= float(x) <= 10000 and b in ("true", "false")
        assert len(d.partition(".")[2]) <= 2
    again = gen.sampled_rows(gen.rule_candidates(df.repartition(6)))
    assert again.exceptAll(drawn).count() == 0
    assert gen.already_seen(drawn, gen.one_hot_rows(found)).count() == 800
    assert gen.sampled_rows(gen.rule_candidates(spark.createDataFrame([("r", [("b", "bool"), ("n", "short")], "x")], RULES))).count() == 0


def test_simple_rows(spark):
    rule = [("r", [("i", "int"), ("f", "float?"), ("o", "Order")], ""), ("z", [], "")]
    assert rows_of(gen.zip_rows(spark.createDataFrame(rule, RULES))) == [["0", "0f", "default(Order)!"], ["1", "1.5f", "default(Order)!"], ["-1", "1.5f", "default(Order)!"], []]


def test_boundary_coverage(spark):
    data = spark.createDataFrame([(v,) for v in [1, 2, 2, 3, 4, 10]], "q int")
    bounds = spark.createDataFrame([("r", "q", 3.0), ("w", "q", 3.0), ("r", "q", 20.0)], "rule_id string, param string, literal double")
    got = {(r.rule_id, r.literal): tuple(r)[3:] for r in gen.boundary_coverage(data, bounds).collect()}
    assert got == {("r", 3.0): (3, 2, 1, 1, 2), ("w", 3.0): (3, 2, 1, 1, 2), ("r", 20.0): (6, 0, 0, 0, 0)}


def test_literals_as_a_compiler_reads_them(spark):
    text = 'if (a >= 1_000 && b == 0x1F && c < 1e3 && d == "x\\"y" && e <= 10UL && s == "z\\\\" && h != 7f) Go();'
    assert literals(spark, text) == {
        ("int", "1000"), ("int", "31"), ("double", "1000.0"), ("string", 'x"y'), ("int", "10"), ("string", "z\\"), ("double", "7.0"),
    }


def test_boundary_coverage_keeps_large_numbers_apart_and_skips_dates(spark):
    big = 2**53
    df = spark.createDataFrame([(big, "2020-01-01"), (big + 1, None)], "a bigint, d string").withColumn("d", F.col("d").cast("date"))
    marks = spark.createDataFrame([("r", "a", float(big))], "rule_id string, param string, literal double")
    row = gen.boundary_coverage(df, marks).first()
    assert (row.n_at, row.n_at_plus_1, row.n_above) == (1, 1, 1)


def test_boundary_coverage_counts_values_beyond_the_decimals(spark):
    inf, nan = float("inf"), float("nan")
    data = spark.createDataFrame([(v,) for v in [1.0, 1e20, 1e20, 3e25, -1e30, inf, -inf, nan, 1e300]], "q double")
    bounds = spark.createDataFrame([("r", "q", x) for x in ["1", "1e20", "-1e30", "1e300", "Infinity", "-Infinity", "NaN", "word"]], "rule_id string, param string, literal string")
    got = {r.literal: (r.n_below, r.n_at_minus_1, r.n_at, r.n_at_plus_1, r.n_above) for r in gen.boundary_coverage(data, bounds).collect()}
    assert got == {
        "1": (2, 0, 1, 0, 6), "1e20": (3, 0, 2, 0, 4), "-1e30": (1, 0, 1, 0, 7), "1e300": (6, 0, 1, 0, 2),
        "Infinity": (7, 0, 1, 0, 1), "-Infinity": (0, 0, 1, 0, 8), "NaN": (8, 0, 1, 0, 0),
    }
    whole = spark.createDataFrame([(str(x),) for x in (10**25 - 1, 10**25, 10**25, 10**25 + 1, 10**20 - 1)], "q string").select(F.col("q").cast("decimal(38,0)"))
    marks = spark.createDataFrame([("r", "q", str(10**25)), ("r", "q", str(10**20))], "rule_id string, param string, literal string")
    got = {r.literal: (r.n_below, r.n_at_minus_1, r.n_at, r.n_at_plus_1, r.n_above) for r in gen.boundary_coverage(whole, marks).collect()}
    assert got == {str(10**25): (2, 1, 2, 1, 1), str(10**20): (1, 1, 0, 0, 4)}


def test_regex_witnesses_reach_the_candidates(spark):
    """Values that the data has for a pattern are among the candidates; patterns that the engine doesn't know have none."""
    params = [("name", "string")]
    texts = {"a": r'Regex.IsMatch(name, "^k.+z$")', "b": r'Regex.IsMatch(name, "(?(x)y|z)")', "c": "name.Length > 3"}
    rules = spark.createDataFrame([(i, params, t) for i, t in texts.items()], RULES)
    assert gen.rule_patterns(rules) == ["^k.+z$"]
    names = spark.createDataFrame([("kaz",), ("kbz",), ("q" * 600,), ("zz",), (None,)], "n string")
    found = gen.witness_dictionary(gen.pattern_witness(names, "n", gen.rule_patterns(rules)))
    got = {r["rule_id"]: r["found"]["candidates"][0] for r in gen.rule_candidates(rules, regex_witnesses=found).collect()}
    plain = {r["rule_id"]: r["found"]["candidates"][0] for r in gen.rule_candidates(rules).collect()}
    assert [x for x in got["a"] if x not in plain["a"]] == ["kaz"] and got["b"] == plain["b"] and got["c"] == plain["c"]
    none = gen.witness_dictionary(gen.pattern_witness(names, "n", ["^k"]).limit(0))
    assert [r["found"]["candidates"][0] for r in gen.rule_candidates(rules.where("rule_id = 'a'"), regex_witnesses=none).collect()] == [plain["a"]]


def test_caps_are_parameters_and_count_what_they_leave_out(spark):
    rules = spark.createDataFrame([("r", [("n", "int"), ("s", "string")], 'n > 5 && n < 90 && s == "x" && s == "y"')], RULES)
    every = gen.rule_candidates(rules, cap=None, string_cap=None).first()["found"]
    few = gen.rule_candidates(rules, cap=2, string_cap=3).first()["found"]
    assert every["left_out"] == [0, 0] and [len(c) for c in few["candidates"]] == [2, 3]
    assert [c[: len(f)] for c, f in zip(every["candidates"], few["candidates"])] == few["candidates"]
    assert few["left_out"] == [len(c) - len(f) for c, f in zip(every["candidates"], few["candidates"])]
    whole = gen.rule_candidates(rules, cap=None, string_cap=None)
    sizes = [len(c) for c in every["candidates"]]
    assert gen.one_hot_rows(whole, cap=None).count() == 1 + sum(n - 1 for n in sizes)
    assert gen.one_hot_rows(whole, cap=2).count() == 2 and gen.struct_variants(rules, cap=3).count() == 3 and gen.zip_rows(rules, cap=1).count() == 1


def test_unseen_rows_are_dealt_by_their_number(spark, monkeypatch):
    """Adaptive execution goes by packed bytes and would leave rows that are alike to one task."""
    monkeypatch.setattr(gen, "ROWS_PER_TASK", 100)
    rows = spark.range(2000).select(
        (F.col("id") % 400).cast("string").alias("rule_id"), F.array(F.lit("same"), (F.col("id") % 5).cast("string"), F.lit(None)).alias("row")
    )
    existing = rows.where("row[1] = '3'").unionByName(rows.where("rule_id = '7'"))
    for most in (None, 2000):
        left = gen.already_seen(rows, existing, most)
        parts = left.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 10 and max(r["count"] for r in parts) <= 250
        # A null in a row is compared as a value.
        want = [(str(i % 400), ("same", str(i % 5), None)) for i in range(2000) if i % 5 != 3 and i % 400 != 7]
        assert sorted((r[0], tuple(r[1])) for r in left.collect()) == sorted(want, key=lambda x: (x[0], x[1][:2]))


def test_candidates_are_computed_once_and_after_the_rules_are_dealt(spark):
    params = [("a", "int"), ("name", "string"), ("b", "bool")]
    rules = spark.createDataFrame([("r", params, 'if (a > 3 && name.Length <= 9)'), ("n", params, None), ("e", [], "a > 1")], RULES)
    found = gen.candidate_rows(gen.rule_candidates(rules.repartition(2, "rule_id"))).where("param = 'name'")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "regexp_extract_all" not in below and "regexp_extract_all" in plan
    every = gen.candidate_rows(gen.rule_candidates(rules)).collect()
    assert [(r.param_no, r.candidate_no) for r in every if (r.rule_id, r.param) == ("r", "b")] == [(3, 1), (3, 2)]
    assert [r.value for r in every if (r.rule_id, r.param) == ("n", "b")] == ["false", "true"]
    assert not [r for r in every if r.rule_id == "e"]
