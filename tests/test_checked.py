"""Checked expressions against Spark's own errors: what fails there has that class here, and the rest is equal."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftlock.functions.checked import CheckedRow, when
from driftlock.operators.lock import capture

ROWS = [
    (1, 2, 7, "12", 2.5, "2024-02-29", [4, 5]), (2, 2147483647, 2, "x", 0.0, "2024-02-30", []), (3, -2147483648, 0, " 8 ", -1.0, None, None),
    (4, None, 3, None, None, "", [1]), (5, 46341, 46341, "99999999999", 1e300, "2023-01-01", [None, 2]), (6, 7, -1, "", float("nan"), "1/2/3", [9, 9, 9]),
]
KIND = "id int, a int, b int, s string, d double, t string, l array<int>"

# name: (checked, plain)
CASES = {
    "add": (lambda r: r["a"] + r["b"], lambda: F.col("a") + F.col("b")),
    "subtract": (lambda r: 1 - r["a"], lambda: F.lit(1) - F.col("a")),
    "multiply": (lambda r: r["a"] * r["b"] + 1, lambda: F.col("a") * F.col("b") + 1),
    "divide": (lambda r: r["a"] / r["b"], lambda: F.col("a") / F.col("b")),
    "divide doubles": (lambda r: r["a"] / r["d"], lambda: F.col("a") / F.col("d")),
    "remainder": (lambda r: r["a"] % r["b"], lambda: F.col("a") % F.col("b")),
    "negative": (lambda r: -r["a"], lambda: -F.col("a")),
    "magnitude": (lambda r: abs(r["a"]), lambda: F.abs("a")),
    "cast text": (lambda r: r["s"].cast("int") + 1, lambda: F.col("s").cast("int") + 1),
    "cast narrower": (lambda r: r["a"].cast("tinyint"), lambda: F.col("a").cast("tinyint")),
    "cast double": (lambda r: r["d"].cast("int"), lambda: F.col("d").cast("int")),
    "cast decimal": (lambda r: r["a"].cast("decimal(4,1)"), lambda: F.col("a").cast("decimal(4,1)")),
    "cast date": (lambda r: r["t"].cast("date"), lambda: F.col("t").cast("date")),
    "timestamp": (lambda r: r["t"].timestamp("yyyy-MM-dd"), lambda: F.to_timestamp("t", "yyyy-MM-dd")),
    "element": (lambda r: r["l"][r["b"]], lambda: F.col("l")[F.col("b")]),
    "branch": (
        lambda r: when(r["b"] != 0, r["a"] / r["b"]).when(r["id"] == 3, r["s"].cast("double")).otherwise(0),
        lambda: F.when(F.col("b") != 0, F.col("a") / F.col("b")).when(F.col("id") == 3, F.col("s").cast("double")).otherwise(0),
    ),
    "and": (lambda r: (r["b"] != 0) & (r["a"] / r["b"] > 1), lambda: (F.col("b") != 0) & (F.col("a") / F.col("b") > 1)),
    "or": (lambda r: (r["b"] == 0) | ~(r["a"] % r["b"] > 1), lambda: (F.col("b") == 0) | ~(F.col("a") % F.col("b") > 1)),
    "function": (lambda r: r["s"].apply(F.concat, "!"), lambda: F.concat("s", F.lit("!"))),
    "null": (lambda r: (r["a"] + r["b"]).is_null(), lambda: (F.col("a") + F.col("b")).isNull()),
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, KIND).coalesce(1).cache()


def outcomes(rows, row, plains):
    """What Spark gives for one row: each value, or the class of the error that it raises."""
    one = rows.where(F.col("id") == row[0])
    out = {}
    for name, plain in plains.items():
        try:
            out[name] = one.select(plain().alias("v")).first()["v"], None
        except PySparkException as error:
            out[name] = None, error.getCondition().split(".")[0]
    return out


def test_every_operation_fails_where_spark_fails(spark, rows):
    row = CheckedRow(rows)
    made = rows.select("id", *[checked(row).pair.alias(name) for name, (checked, _) in CASES.items()])
    failed = set()
    for got, row in zip(made.orderBy("id").collect(), ROWS):
        for name, (value, error) in outcomes(rows, row, {name: plain for name, (_, plain) in CASES.items()}).items():
            told = got[name]["error"] and got[name]["error"].split(":")[0]
            assert (repr(got[name]["value"]), told) == (repr(value), error), (name, row)
            failed.add(told)
    assert failed >= {
        None, "ARITHMETIC_OVERFLOW", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "CAST_INVALID_INPUT", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE",
        "CANNOT_PARSE_TIMESTAMP", "INVALID_ARRAY_INDEX",
    }


def test_a_long_formula_stays_small(spark, rows):
    """Operands and named steps are bound once: the expression grows with the formula, not with its power."""

    def formula(r):
        total = r["a"].cast("bigint")
        for i in range(8):
            total = total.bind(lambda t, i=i: t + t * (i + 1) - r["b"])
        return {"total": total}

    done = capture(rows, None, "id", "id", ["a"], ["total"], checked=formula)
    assert len(done._jdf.queryExecution().analyzed().toString()) < 100_000
    got = {r["unit_id"]: r["outcome"] for r in done.collect()}
    total = 46341
    for i in range(8):
        total = total + total * (i + 1) - 46341
    assert got["5"] == str(total) and got["4"] == "null"


def test_capture_records_the_first_error(rows):
    def logic(r):
        return {
            "share": r["a"] / r["b"],
            "parsed": r["s"].cast("int").refuse(r["d"] < 0, "NegativeRate", "rates are not negative"),
        }

    done = capture(rows, None, "id", "id", ["a", "b"], ["share", "parsed"], ["parsed"], checked=logic).orderBy("entry_no")
    got = [(r["outcome"], r["is_error"], r["captures"][0]["value"]) for r in done.collect()]
    assert got[0] == ('{"share":0.2857142857142857,"parsed":12}', False, "12")
    assert got[1][0] == "CAST_INVALID_INPUT: 'x' is no int" and got[2][0] == "DIVIDE_BY_ZERO: division by zero"
    assert got[4][0] == "CAST_INVALID_INPUT: '99999999999' is no int" and [g[1] for g in got] == [False, True, True, False, True, True]
    only = capture(rows.where("id = 3"), None, "id", "id", ["a"], ["parsed"], checked=lambda r: {"parsed": logic(r)["parsed"]}).first()
    assert only["outcome"] == "NegativeRate: rates are not negative"
    with pytest.raises(TypeError):
        capture(rows, None, "id", "id", ["a"], ["x"], checked=lambda r: {"x": r["a"] if r["b"] else r["a"]})
