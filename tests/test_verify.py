import pytest
from pyspark.sql import functions as F

from driftlock.operators import verify as v


def status(df, key="k"):
    return {r[key]: (r.status, r.changed_cols) for r in df.collect()}


@pytest.fixture(scope="module")
def pair(spark):
    schema = "k int, a double, m map<string,int>, t string"
    nan, zero = float("nan"), -0.0
    old = spark.createDataFrame(
        [
            (1, 1.0, {"x": 1, "y": 2}, "a"),
            (2, nan, {}, None),
            (3, 0.0, None, "c"),
            (4, 4.0, {"x": 1}, "d"),
            (None, 5.0, None, "e"),
        ],
        schema,
    )
    new = spark.createDataFrame(
        [
            (1, 1.0, {"y": 2, "x": 1}, "a"),
            (2, nan, {}, None),
            (3, zero, {}, "C"),
            (None, 5.5, None, "e"),
            (9, 1.0, None, "z"),
        ],
        schema,
    )
    return old, new


def test_statuses(pair):
    got = status(v.verify(*pair, ["k"]))
    assert got == {
        1: ("identical", []),
        2: ("identical", []),
        3: ("changed", ["m", "t"]),
        4: ("missing", []),
        None: ("changed", ["a"]),
        9: ("added", []),
    }
    assert status(v.verify(*pair, ["k"], on_duplicates="bag")) == got


def test_tolerance_and_columns(pair):
    got = status(v.verify(*pair, ["k"], cols=["a"], tolerance={"a": 0.5}))
    assert got[None] == ("identical", []) and got[3] == ("identical", [])


def test_reference_statuses(pair):
    got = status(v.verify(*pair, ["k"], reference_statuses=True))
    assert got[4][0] == "identical" and 9 not in got


def test_table_against_itself_is_identical_whatever_the_partitioning(spark):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"), F.array("id").alias("a"))
    verdicts = v.verify(df, df.repartition(13).orderBy(F.desc("id")), ["id"])
    row = v.verify_summary(verdicts).first()
    assert (row.total, row.identical, row.preserved, row.gate_code) == (1000, 1000, True, 0)


def test_one_tampered_cell_is_one_change(spark):
    df = spark.range(1000).select("id", (F.col("id") / 7).alias("x"))
    bad = df.withColumn("x", F.when(F.col("id") == 500, 0.0).otherwise(F.col("x")))
    row = v.verify_summary(v.verify(df, bad, ["id"])).first()
    assert (row.changed, row.identical, row.preserved, row.gate_code) == (1, 999, False, 1)
    cell = v.cell_delta(df, bad, ["id"]).collect()
    assert [(c.id, c.column, c.new) for c in cell] == [(500, "x", "0.0")]
    assert v.cell_counts(v.cell_delta(df, bad, ["id"])).first().n_changed == 1


def test_duplicate_keys_are_refused(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, t string")
    with pytest.raises(v.DuplicateKeys):
        v.verify(df, df, ["k"], on_duplicates="fail")
    once = df.where("t = 'a'")
    for old, new, side in ((df, once, "baseline"), (once, df, "current"), (once.limit(0), df, "current")):
        with pytest.raises(Exception, match=f"several rows for one key in {side}: 1"):
            v.verify(old, new, ["k"]).collect()


def test_null_keys_meet_null_keys_only(spark):
    schema = "a int, s string, d date, v int"
    old = spark.createDataFrame([(None, "", None, 1), (0, None, None, 2), (0, "", None, 3)], schema)
    new = spark.createDataFrame([(0, "", None, 3), (None, "", None, 1), (0, None, None, 9)], schema)
    got = {(r.a, r.s): r.status for r in v.verify(old, new, ["a", "s", "d"]).collect()}
    assert got == {(None, ""): "identical", (0, None): "changed", (0, ""): "identical"}
    maps = spark.createDataFrame([({"x": 1}, 1), (None, 2)], "m map<string,int>, v int")
    assert {r.status for r in v.verify(maps, maps, ["m"]).collect()} == {"identical"}


def test_repeated_keys_as_bags(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "x"), (3, "q"), (4, "p")], "k int, t string")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "x"), (2, "x"), (3, None), (5, "p")], "k int, t string")
    got = {r.k: (r.status, r.changed_cols, r.n_old, r.n_new) for r in v.verify_bag(old, new, ["k"]).collect()}
    assert got == {
        1: ("identical", [], 3, 3),
        2: ("changed", [], 1, 2),
        3: ("changed", ["t"], 1, 1),
        4: ("missing", [], 1, 0),
        5: ("added", [], 0, 1),
    }


def test_empty_suite_fails_and_empty_scope_passes(spark):
    none = spark.createDataFrame([], "status string")
    assert v.verify_summary(none).first().gate_code == 1
    assert v.verify_summary(none, in_scope=False).first().gate_code == 0
    one = spark.createDataFrame([("identical",)], "status string")
    broke = v.verify_summary(one, broke=True).first()
    assert (broke.preserved, broke.gate_code) == (False, 1)


def test_schema_break(spark, pair):
    old, _ = pair
    now = old.drop("t").withColumn("a", F.col("a").cast("string"))
    errors = v.schema_break(old.schema, now)
    assert len(errors) == 2 and "'a' changed type from double to string" in errors[0]
    assert v.schema_break(old.schema, old) == []
    with pytest.raises(v.SchemaBreak):
        v.verify(old, now, ["k"])


def test_bag_diff_with_maps(pair):
    got = {(r.k, r.side, r.n) for r in v.bag_diff(*pair).collect()}
    assert got == {(3, "-", 1), (3, "+", 1), (4, "-", 1), (None, "-", 1), (None, "+", 1), (9, "+", 1)}


def test_fingerprint(spark, pair):
    old, new = pair
    assert v.fingerprint(old).first() == v.fingerprint(old.repartition(3).orderBy(F.desc("k"))).first()
    assert v.fingerprint(old).first() != v.fingerprint(new).first()
    twice = old.union(old)
    assert v.fingerprint(twice).first() != v.fingerprint(twice.limit(0)).first()
