import warnings

import pytest
from pyspark.sql import functions as F

from driftlock.operators import lock, mutate
from driftlock.operators.scores import mutation_scores
from driftlock.operators.verify import verify, verify_summary
from driftlock.sources import baseline as store
from driftlock.streaming import gate


def test_capture_records_values_errors_and_void(spark):
    inputs = spark.createDataFrame([("u", 1, 10, 2), ("u", 2, 10, 0), ("u", 3, None, 1)], "unit string, n int, a int, b int")
    rules = lambda df: [lock.ErrorRule(F.col("b") == 0, "DivideByZeroException", "no")]
    done = lock.capture(
        inputs, lambda d: d.withColumn("q", F.try_divide("a", "b")), "unit", "n", ["a", "b"], ["q"], ["b"], rules
    )
    got = {r.entry_no: (r.input, r.outcome, r.is_error, r.captures[0].value) for r in done.collect()}
    assert got == {
        1: ("(10, 2)", "5.0", False, "2"),
        2: ("(10, 0)", "DivideByZeroException: no", True, "0"),
        3: ("(null, 1)", "null", False, "1"),
    }
    void = lock.capture(inputs, lambda d: d, "unit", "n", ["a"], [])
    assert {r.outcome for r in void.collect()} == {"completed (no return value)"}
    both = lock.capture(inputs, lambda d: d, "unit", "n", ["a"], ["a", "b"])
    assert both.where("entry_no = 1").first().outcome == '{"a":10,"b":2}'


def test_random_unit_is_quarantined(spark):
    base = spark.range(20).select(F.concat(F.lit("u"), (F.col("id") % 4).cast("string")).alias("unit_id"), F.col("id").alias("entry_no"))

    def run():
        return base.withColumn("outcome", F.when(F.col("unit_id") == "u2", F.uuid()).otherwise("x"))

    stable, bad = lock.quarantine_flaky(run(), run(), ["unit_id", "entry_no"])
    assert [r.unit_id for r in bad.collect()] == ["u2"]
    assert {r.unit_id for r in stable.select("unit_id").distinct().collect()} == {"u0", "u1", "u3"}


def test_secrets_do_not_look_flaky(spark):
    run = spark.createDataFrame([("u", 1, 'token = "abc"')], "unit_id string, entry_no int, outcome string")
    other = spark.createDataFrame([("u", 1, 'token = "xyz"')], "unit_id string, entry_no int, outcome string")
    stable, bad = lock.quarantine_flaky(run, other, ["unit_id", "entry_no"])
    assert bad.count() == 0 and stable.first().outcome == 'token = "[REDACTED]"'


def test_diagnosis_names_known_obstacles_first(spark):
    a = spark.createDataFrame([("u", 1, "x"), ("w", 1, "2024-01-01 10:00:00")], "unit string, k int, v string")
    b = spark.createDataFrame([("u", 1, "y"), ("w", 1, "2024-01-02 10:00:00")], "unit string, k int, v string")
    known = spark.createDataFrame([("u", ["DateTime.Now", "b", "c", "d", "e"])], "unit string, obstacles array<string>")
    got = {r.unit: r for r in lock.diagnose_flaky(a, b, ["k"], "unit", known).collect()}
    assert "DateTime.Now, b, c, d," in got["u"].message and "e" not in got["u"].message.split(",")
    assert got["w"].causes == ["time"]


def test_accept_then_verify(spark):
    old = spark.createDataFrame([("Pay.Run", 1, "old"), ("Pay.Stop", 1, "old"), ("Log.Run", 1, "same")], "name string, n int, v string")
    new = spark.createDataFrame([("Pay.Run", 1, 'secret = "x"'), ("Pay.Stop", 1, "new"), ("Log.Run", 1, "same"), ("Added", 1, "a")], "name string, n int, v string")
    keys = ["name", "n"]
    with pytest.raises(ValueError):
        lock.accept(old, new, keys)
    with pytest.raises(lock.NothingMatches):
        lock.accept(old, new, keys, name="nothing")
    some = lock.accept(old, new, keys, name="pay.r")
    assert (some.accepted, some.remaining) == (1, 1)
    assert some.baseline.where("name = 'Pay.Run'").first().v == 'secret = "[REDACTED]"'
    assert some.baseline.where("name = 'Pay.Stop'").first().v == "old"
    everything = lock.accept(old, new.where("name <> 'Pay.Run'"), keys, accept_all=True)
    left = verify(everything.baseline.where("name <> 'Pay.Run'"), new.where("name not in ('Pay.Run', 'Added')"), keys)
    assert verify_summary(left).first().preserved
    same = lock.accept(old, old, keys, accept_all=True)
    assert (same.accepted, same.baseline.count()) == (0, 3)


def test_baseline_versions(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, 'password = "p"'), (2, "plain")], "k int, v string")
    assert store.write_baseline(df, root, "b", ["k"]) == 1
    assert store.write_baseline(df.where("k = 2"), root, "b", ["k"]) == 2
    assert store.versions(spark, root, "b") == [1, 2]
    assert store.read_baseline(spark, root, "b").count() == 1
    first = {r.k: r.v for r in store.read_baseline(spark, root, "b", 1).collect()}
    assert first == {1: 'password = "[REDACTED]"', 2: "plain"}
    manifest = store.read_manifest(spark, root, "b", 1)
    assert (manifest["format"], manifest["n_rows"]) == (1, 2)
    with pytest.raises(ValueError):
        store.write_baseline(df, root, "b", ["k"], version=1)
    for name in ("../out", "/abs", "a/b", ".."):
        with pytest.raises(ValueError):
            store.write_baseline(df, root, name, ["k"])
    with pytest.raises(FileNotFoundError):
        store.read_baseline(spark, root, "other")


def test_newer_format_warns_and_missing_stamp_is_zero(spark, tmp_path):
    root = str(tmp_path)
    spark.range(1).write.parquet(f"{root}/n/data/version=1")
    spark.range(1).selectExpr("1 as version", "99 as format").write.json(f"{root}/n/manifest/1")
    with pytest.warns(UserWarning, match="format 99"):
        store.read_baseline(spark, root, "n")
    spark.range(1).write.parquet(f"{root}/o/data/version=1")
    spark.range(1).selectExpr("1 as version").write.json(f"{root}/o/manifest/1")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        store.read_baseline(spark, root, "o")
    assert store.read_manifest(spark, root, "o", 1)["format"] == 0


def test_received_output_replaces_an_earlier_run(spark, tmp_path):
    store.write_received(spark.range(5), str(tmp_path), "b")
    assert store.write_received(spark.range(2), str(tmp_path), "b").count() == 2


def test_batch_isolates_a_broken_target(spark):
    good = spark.createDataFrame([("u", 1, 1)], "unit string, n int, v int")
    entry = lambda df: lock.capture(df, lambda d: d, "unit", "n", ["v"], ["v"])
    targets = [
        lock.Target("a", lambda: entry(good)),
        lock.Target("b", lambda: entry(good.select("nope"))),
        lock.Target("c", lambda: entry(good)),
        lock.Target("d", lambda: entry(good)),
    ]
    entries, results = lock.lock_batch(spark, targets, max_targets=3)
    assert entries.count() == 2
    rows = results.orderBy("position").collect()
    assert [(r.unit, r.success) for r in rows] == [("a", True), ("b", False), ("c", True), ("d", False)]
    assert "nope" in rows[1].diagnostics[0] and rows[3].diagnostics == ["not processed"]


def test_prove(spark):
    df = spark.range(4000).select("id", (F.col("id") % 5 + 1).cast("int").alias("a"), F.lit("x").alias("free"))
    mutations = [
        mutate.Mutation("m0", "off_by_one", "a", file="A"),
        mutate.Mutation("m1", "null_out", "free", file="A"),
        mutate.Mutation("m2", "boundary_swap", "free", "x", file="B"),
        mutate.Mutation("m3", "row_drop", file="B"),
        mutate.Mutation("m4", "row_duplicate", file="B"),
    ]
    mutated = mutate.mutate(df, ["id"], mutations)
    again = mutate.mutate(df.repartition(7), ["id"], mutations)
    assert mutated.exceptAll(again).count() == 0 and again.exceptAll(mutated).count() == 0
    narrow = {r.mutant_id: r.status for r in mutate.prove(mutated, ["id"], mutations, ["a"]).collect()}
    assert narrow == {"m0": "Killed", "m1": "NoCoverage", "m2": "NoCoverage", "m3": "Killed", "m4": "Killed"}
    wide = mutate.prove(mutated, ["id"], mutations, ["a", "free"])
    assert {r.mutant_id: r.status for r in wide.collect()}["m2"] == "Survived"
    score = {r.file: round(r.score, 1) for r in mutation_scores(wide).collect()}
    assert score == {"A": 100.0, "B": 66.7, None: 80.0}


def test_stream_batches_and_rerun(spark, tmp_path):
    locked = spark.range(10).select("id", F.lit(1).alias("v"))
    now = spark.range(12).select("id", F.when(F.col("id") == 3, 2).otherwise(1).alias("v"))
    verdicts = gate.batch_verdicts(now, locked, ["id"]).groupBy("status").count()
    assert {r.status: r["count"] for r in verdicts.collect()} == {"identical": 9, "changed": 1, "added": 2}
